import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings, strategies as st

from lakeveil.llm import simhash
from lakeveil.llm.common import Scratch, text_buffer
from lakeveil.llm.components import connected_components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB É\n\tz", max_size=40), max_size=6))
def test_prints_equal_plain(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    got = simhash.fingerprints(raw, offsets).view(np.uint64)
    assert [int(x) for x in got] == [plain_print(t) for t in texts]


def test_links_equal_brute_force(spark):
    r = random.Random(5)
    fps = {r.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:8]:  # chains and crowds
        for _ in range(40):
            base ^= 1 << r.randrange(64)
            base ^= (1 << r.randrange(64)) * r.randrange(2)
            fps.add(base)
    centre = r.getrandbits(64)
    fps |= {centre ^ (1 << i) for i in range(64)} | {centre ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) for _ in range(80)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = plain_roots(signed, lambda a, b: bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for paired in (16, 2):
        s = Scratch(spark, "t")
        got = {x.node: x.root for x in connected_components(s, simhash.links(s, df, paired)).collect()}
        assert {n: got.get(n, n) for n in signed} == want


def test_components_of_a_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    s = Scratch(spark, "t")
    got = {x.node: x.root for x in connected_components(s, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " end"), (9, "other words that stand alone here"), (7, None), (2, ""), (2, ""), (None, base), (11, base.upper()), (12, "x"), (13, "a " * 200_000)]
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df).collect()
    want = plain_roots({plain_print(t or "") for _, t in rows}, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for i, t in rows:
        if i is not None:
            c = want[plain_print(t or "")]
            least[c] = min(least.get(c, i), i)
    assert sorted((x.doc_id or -1, x.fingerprint, x.component_id) for x in out) == sorted((i or -1, f"{plain_print(t or ''):016x}", least[want[plain_print(t or "")]]) for i, t in rows)
    kept = simhash.keep_one(df)
    assert sorted(x.doc_id or -1 for x in kept.collect()) == sorted([-1, *set(least.values())]) and kept.columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0
