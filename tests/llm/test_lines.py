import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from lakeveil.llm import lines
from lakeveil.llm.common import text_buffer

LOW = -(1 << 63)


def plain(rows):
    """Texts without repeated lines, by all pairs."""
    docs = sorted({(i if i is not None else LOW, t or "") for i, t in rows})
    spots = [(d, k, x) for d in docs for k, x in enumerate(d[1].split("\n")) if x.strip(" \t\r\x0b\x0c")]
    names = list(dict.fromkeys(x for _, _, x in spots))
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if lines.similar(a, b):
                root[find(a)] = find(b)
    seen, gone = set(), {}
    for d, k, x in spots:
        if find(x) in seen:
            gone.setdefault(d, set()).add(k)
        seen.add(find(x))
    return {d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone.get(d, ())) for d in docs}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aé \n\t😀", max_size=20), max_size=6))
def test_lines_are_those_of_split(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    x = lines.Lines(raw, offsets)
    whole = "".join(texts)
    got = [(int(d), int(k), whole[a:b]) for d, k, a, b in zip(x.doc, x.number, x.start, x.end)]
    assert got == [(d, k, line) for d, t in enumerate(texts) for k, line in enumerate(t.split("\n")) if line.strip(" \t\r\x0b\x0c")]
    assert len({v: h for (_, _, v), h in zip(got, x.hash.tolist())}) == len(set(x.hash.tolist()))


def test_recall_of_the_keys():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(300)]
    found = total = 0
    for _ in range(300):
        a = [r.choice(words) for _ in range(40)]
        b = a.copy()
        for _ in range(r.randrange(1, 3)):
            b[r.randrange(40)] = r.choice(words)
        x, y = " ".join(a), " ".join(b)
        if lines.similar(x, y) and x != y:
            raw, offsets = text_buffer(pa.array([x + "\n" + y]))
            k = lines.keys(lines.Lines(raw, offsets), np.array([0, 1]))
            total += 1
            found += bool((k[0] == k[1]).any())
    assert total > 100 and found / total > 0.97


def test_equals_brute_force(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(2, 9))) for _ in range(200)]
    bank = [" ".join(r.choice(words) for _ in range(r.randrange(3, 40))) for _ in range(40)]
    rows = []
    for i in range(150):
        own = []
        for _ in range(r.randrange(6)):
            x = r.choice(bank)
            if r.random() < 0.5 and len(x) > 150:
                k = r.randrange(len(x))
                x = x[:k] + r.choice("XYZ") + x[k + 1 :]
            own.append(r.choice([x, "short", "", " ", "é", " ".join(r.choice(words) for _ in range(20))]))
        rows.append((i, "\n".join(own)))
    near = " ".join(r.choice(words) for _ in range(80))
    rows += [(300 + i, near[:k] + "Q" + near[k + 1 :]) for i, k in enumerate(range(0, 300, 6))]  # a crowd of distinct near copies
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, bank[0]), (3, rows[3][1]), (503, "w " * 100_000), (504, "\n".join(["same"] * 2000))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, rk int, drop int").repartition(3)
    out = lines.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_removed"]
    want = plain(rows)
    order = lambda x: (x[0] is not None, x[0] or 0, x[1] or "")
    got = sorted(((x.doc_id, x.text) for x in out.collect()), key=order)
    assert got == sorted(((i, t and want[(i if i is not None else LOW, t)]) for i, t in rows), key=order)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_one_edit_in_short_lines():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz "
    for size in range(30, 101, 5):
        pairs = []
        for _ in range(60):
            a = "".join(r.choice(letters) for _ in range(size - 1)) + "x"
            k = r.randrange(10, size - 10)
            pairs.append((a, a[:k] + "é" + a[k + 1 :]))
        alike = [lines.similar(*p) for p in pairs]
        assert all(alike) or size < 40
        raw, offsets = text_buffer(pa.array(["\n".join(p) for p in pairs]))
        x = lines.Lines(raw, offsets)
        k = lines.keys(x, lines.short_lines(x, np.arange(len(x.doc))), lines.SHORT_BANDS, lines.SHORT_ROWS, width=lines.SHORT_SHINGLE)
        met = (k[::2] == k[1::2]).any(axis=1)
        assert met[alike].mean() > 0.9 if any(alike) else size < 40


def test_short_lines_with_one_edit_go(spark):
    rows = [(i, f"All rights reserved by the authors of te{c}t books.") for i, c in enumerate("xsnrlm")] + [(9, "Something else stands in this short line here.")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in out if x.text} == {0, 9}


def test_recall_of_the_strict_keys_at_the_threshold():
    r = random.Random(6)
    pairs = []
    while len(pairs) < 300:
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(399)) + "x"
        b = list(a)
        for _ in range(r.randrange(3, 8)):
            b[r.randrange(400)] = r.choice("QWERTZ")
        x, y = lines.shingle_set(a), lines.shingle_set("".join(b))
        if 0.8 <= len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < 0.815:
            pairs.append((a, "".join(b)))
    raw, offsets = text_buffer(pa.array(["\n".join(p) for p in pairs]))
    x = lines.Lines(raw, offsets)
    k = lines.keys(x, np.arange(len(x.doc)), lines.STRICT_BANDS, lines.STRICT_ROWS, lines.STRICT_RUNS)
    first = lines.keys(x, np.arange(len(x.doc)))
    met = lambda z: (z[::2] == z[1::2]).any(axis=1).mean()
    assert met(k) >= 0.985 and met(k) >= met(first) - 0.01


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "one two three\none two three", 5, "a", 7), (2, None, 6, "b", 8)], "doc_id long, text string, n_lines_removed int, `__rk` string, `DROP` int")
    out = lines.dedup_lines(df)
    assert out.columns == ["doc_id", "text", "__rk", "DROP", "n_lines_removed"]
    assert sorted(map(tuple, out.collect())) == [(1, "one two three", "a", 7, 1), (2, None, "b", 8, 0)]


def test_recall_in_a_crowd(spark):
    """Copies of one line, each with its own changes, are mostly just under the threshold to each other: crowded keys."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    base = [r.choice(words) for _ in range(80)]
    rows = []
    for i in range(500):
        own = base.copy()
        for _ in range(r.randrange(1, 5)):
            own[r.randrange(80)] = r.choice(words)
        rows.append((i, " ".join(own)))
    shingles = [lines.shingle_set(x) for _, x in rows]
    links = [(i, j) for i in range(500) for j in range(i) if lines.similar_sets(shingles[i], shingles[j])]
    near = sum(0.6 <= len(np.intersect1d(shingles[i], shingles[j])) / len(np.union1d(shingles[i], shingles[j])) < 0.8 for i in range(0, 500, 10) for j in range(0, 500, 10))
    assert near > 300 and len(links) > 1000
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = {i for i in range(500) if not any(find(j) == find(i) for j in range(i))}
    got = {x.doc_id for x in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x.text}
    assert want <= got  # nothing goes that is not linked
    assert len(got - want) <= 0.01 * (500 - len(want))


def test_cells_count_as_pairs_do():
    r = random.Random(11)
    bank = ["".join(r.choice("abcdefgh ") for _ in range(n)) for n in (1, 3, 4, 5, 7, 8, 9, 20, 45, 90, 150, 170, 400)] + ["a" * 30, "ab" * 40, "é€" * 30, "€" * 60]
    rows = list(dict.fromkeys(x[:k] + r.choice("aXé€") + x[k + 1 :] if r.random() < 0.8 else x for x in bank * 12 for k in [r.randrange(len(x))]))
    c = np.arange(100, 100 + len(rows), dtype=np.int64)
    c[5] = c[9]  # joined before
    for left, right in ((range(len(rows)), range(len(rows))), (range(0, len(rows), 3), [i for i in range(len(rows)) if i % 3])):
        roots = []
        for links in (lines.cell_links(rows, c, np.array(left), np.array(right)), [(c[i], c[j]) for i in left for j in right if i != j and lines.similar(rows[i], rows[j])]):
            root = {int(x): int(x) for x in c}
            for a, b in links:
                low, high = sorted((root[int(a)], root[int(b)]))
                root = {x: low if y == high else y for x, y in root.items()}
            roots.append(root)
        assert roots[0] == roots[1] and 20 < len(set(roots[0].values())) < len(rows) - 50


def crowd():
    """Lines of one crowd, and the places of two that are alike: all keys they share are crowded by lines that are under the
    threshold to them and, mostly, to each other."""
    r = random.Random(1)
    base = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(399)) + "x"

    def edited(n):
        x = list(base)
        for k in range(n):
            x[10 + 95 * k + r.randrange(60)] = r.choice("QWERTZUIOPASDFGHJKLYXCVBNM")
        return "".join(x)

    rows = [edited(4) for _ in range(1200)]
    at = 300, 900
    for i, where in zip(at, (87, 277)):  # away from all other edits
        x = list(base)
        x[where], x[where + 95] = "1", "2"
        rows[i] = "".join(x)
    return rows, at


def test_no_link_within_a_crowded_key_is_lost(spark, monkeypatch):
    rows, at = crowd()
    raw, offsets = text_buffer(pa.array(["\n".join(rows)]))
    k = lines.keys(lines.Lines(raw, offsets), np.arange(len(rows)))
    shared = np.flatnonzero(k[at[0]] == k[at[1]])
    assert lines.similar(rows[at[0]], rows[at[1]]) and len(shared) and all((k[:, j] == k[at[0], j]).sum() > 100 for j in shared)
    kept = []
    for size in (100, 512):  # many blocks, and few
        monkeypatch.setattr(lines, "CELL_LINES", size, raising=False)
        out = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
        kept.append({x.doc_id for x in out if x.text})
    assert kept[0] == kept[1] and at[0] in kept[0] and at[1] not in kept[0]
    shingles = [lines.shingle_set(x) for x in rows]
    for i in set(range(len(rows))) - kept[0]:
        assert any(lines.similar_sets(shingles[i], shingles[j]) for j in range(len(rows)) if j != i)


def test_keys_are_dealt_as_blocks_and_none_is_lost(monkeypatch):
    """Many keys of each size travel as few rows; workers that hold a handful of rows find the same as one that holds all."""
    r = random.Random(13)
    own = [r.randrange(-(1 << 63), 1 << 63) for _ in range(3000)]
    signed = [(i, [r.choice(own[:9] if i % 3 else own[9:59]) for _ in range(lines.BANDS)], [r.choice(own[100:]) for _ in range(lines.SHORT_BANDS)]) for i in range(400)]
    want = {}
    for i, base, short in signed + signed[:50]:
        for k in base + short:
            want.setdefault(k, set()).add(i)
    assert {2, 3, 16, 17} <= {len(x) for x in want.values()} and max(map(len, want.values())) > 100
    value = lambda i, x: np.array([i, *x], np.int64).tobytes()
    column = lambda rows, at: pa.array([value(x[0], x[at]) for x in rows], pa.binary())
    for held in (40, 1 << 20):
        monkeypatch.setattr(lines, "HELD", held)
        rows = signed + signed[:50]
        dealt = [x for b in lines._dealt(5)[0](pa.record_batch([column(rows[i : i + 7], 1), column(rows[i : i + 7], 2)], ["signed", "brief"]) for i in range(0, 450, 7)) for x in zip(*(c.to_pylist() for c in b.columns))]
        assert held == 40 or len(dealt) <= 32
        dealt.sort(key=lambda x: x[0])
        batches = [pa.record_batch([pa.array([b for b, _ in dealt[i : i + 3]], pa.int64()), pa.array([x for _, x in dealt[i : i + 3]], pa.binary())], ["bucket", "rows"]) for i in range(0, len(dealt), 3)]
        pairs, found = set(), {}
        for a, b, key, many in (x for out in lines._candidates()[0](batches) for x in zip(*(c.to_pylist() for c in out.columns))):
            if key is not None:
                found.setdefault(key, set()).add((b, many))
            elif a != b:
                pairs.add((a, b))
        assert pairs == {tuple(sorted(x)) for x in want.values() if len(x) == 2}
        assert found == {k: {(i, len(x) > lines.PAIRED) for i in x} for k, x in want.items() if len(x) > 2}
