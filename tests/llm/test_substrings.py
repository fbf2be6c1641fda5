import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from lakeveil.llm import substrings
from lakeveil.llm.common import text_buffer


def plain(rows, length):
    docs = sorted({(i if i is not None else -(1 << 63), t or "") for i, t in rows})
    first, words = {}, {}
    for d in docs:
        words[d] = re.findall(r"[^\x20\x09-\x0D]+", d[1])
        for s in range(len(words[d]) - length + 1):
            first.setdefault(tuple(words[d][s : s + length]), (d, s))
    out = {}
    for d in docs:
        hit = [False] * len(words[d])
        for s in range(len(words[d]) - length + 1):
            if first[tuple(words[d][s : s + length])] != (d, s):
                hit[s : s + length] = [True] * length
        kept = [w for w, h in zip(words[d], hit) if not h]
        out[d] = (len(hit), sum(hit), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return sorted(((i if i is not None else -1), *out[(i if i is not None else -(1 << 63), t or "")]) for i, t in rows)


def test_equals_brute_force(spark):
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "A|b"]
    passages = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(15, 60))) for _ in range(8)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(r.randrange(4)):
            parts.append(" ".join(r.choice(vocabulary) for _ in range(r.randrange(30))))
            p = r.choice(passages).split()
            a = r.randrange(len(p))
            parts.append("\n".join(p[a:] if r.random() < 0.5 else p[: a + 1]))
        rows.append((i, r.choice([" ", "  \t"]).join(parts)))
    rows += [(200 + i, passages[0]) for i in range(30)]
    rows += [(300, "x " * 5000), (301, "a b " * 3000), (302, None), (303, ""), (304, "only four words here"), (None, passages[1]), (200, passages[0]), (200, passages[0])]
    rows += [(400, " ".join(str(j) for j in range(100_000)))]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, rk int").repartition(5)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(df).collect())
    assert got == plain(rows, 20)
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(df.where("doc_id < 300"), length=12, gram=4).collect())
    assert got == plain([x for x in rows if x[0] is not None and x[0] < 300], 12)
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_extension_both_ways():
    text = lambda a, b: " ".join([f"l{a}{i}" for i in range(20)] + [f"m{i}" for i in range(25)] + [f"r{b}{i}" for i in range(20)])
    raw, offsets = text_buffer(pa.array([text(0, 0), text(1, 1)]))
    b = substrings.Block(raw, offsets)
    seeds, anchor, place, open_ = substrings.Seeds.of(b, np.arange(len(b.at)))
    doc = b.words.doc[place]
    pairs = [(i, j) for i in np.flatnonzero(doc == 0) for j in np.flatnonzero(doc == 1) if anchor[i] == anchor[j]]
    assert pairs
    got = set()
    for i, j in pairs:
        hit = substrings.extended(seeds.take([j]), seeds.take([i]), 14) & open_[j]
        got |= {int(place[j] - b.words.first[1] - o) for o in substrings._bits(hit)[1]}
    assert got == set(range(20, 26))  # all windows of the 25 words, and no other


def test_anchors_of_many_holders_and_little_memory(spark, monkeypatch):
    """Split anchors, tasks that forget, groups over several batches: the same result."""
    r = random.Random(2)
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(300):
        x = common.copy()
        if i % 3:
            x[r.randrange(30)] = f"v{r.randrange(4)}"
        rows.append((i, " ".join([f"a{r.randrange(6)}" for _ in range(12)] + x + [f"b{r.randrange(6)}" for _ in range(12)])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(substrings, "PART", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = sorted((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(df).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows, 20)
