from fractions import Fraction

import numpy as np
from hypothesis import given, settings, strategies as st

from lakeveil.llm import mixing, topk


def plain(rows, k, every):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % every == 0:
            hits = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i and len(c) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=20) * (3 if i % 7 else 0.1))]) for i in range(600)]
    rows += [(600, rows[3][1]), (601, rows[3][1]), (601, rows[3][1]), (602, None), (603, [None] * 20), (604, [float("nan")] * 20), (650, [float("inf")] + [0.0] * 19), (700, [1.0, 2.0]), (701, [2.0, 1.0]), (None, rows[0][1]), (750, []), (751, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    want = plain(rows, 5, 50)
    for block in (4096, 4):
        assert sorted(map(tuple, topk.top_k(df, query_block=block).collect())) == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 0")).count() == 0


def test_huge_components_are_exact(spark):
    rows = [(0, [1e9, -3.0]), (1, [1e4, 2.0]), (2, [1e4, 1.0]), (3, [-1e4, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [r.vec_id for r in topk.top_k(df).orderBy("rank").collect()] == [2, 1, 3]


def test_ranks_follow_scores_beyond_64_bits(spark):
    """Scores that are the same once cut to 64 bits are still told apart; below them small ones stay exact."""
    big = 2.0**50
    rows = [(0, [big, 1.0]), (1, [big, 0.0]), (2, [big, 7.0]), (3, [2 * big, 0.0]), (4, [-big, 5.0]), (5, [-2 * big, 0.0]), (6, [0.0, -3.0]), (7, [2.0**20, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, k=7).orderBy("rank").collect()
    q = [int(256 * x) for x in rows[0][1]]
    exact = sorted((-sum(a * int(256 * b) for a, b in zip(q, v)), i) for i, v in rows[1:])
    cut = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    assert [(r.vec_id, r.score) for r in got] == [(i, cut(-s)) for s, i in exact]


def test_no_vector_passes_through_the_driver(spark, monkeypatch):
    """Many query groups and candidate groups; the driver sees counts alone."""
    r = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=6))]) for i in range(900)]
    rows += [(50, rows[50][1])] * 2
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    taken = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: taken.append(self.columns) or collect(self))
    out = topk.top_k(df, query_block=5)
    assert taken == [["query", "blocks", "n", "cells"]]
    monkeypatch.undo()
    assert sorted(map(tuple, out.collect())) == plain(rows, 5, 50)


def ideal(blocks, weights, slots):
    """Blocks of each source that the ideal has served after each number of slots, in fractions."""
    blocks, exact = [int(n) for n in blocks], [Fraction(float(w)) for w in weights]
    served, out = [Fraction(0)] * len(blocks), []
    for _ in range(slots):
        left = Fraction(1)
        while left > 0:
            active = [s for s, n in enumerate(blocks) if served[s] < n]
            rate = sum(exact[s] for s in active)
            step = min([left] + [(blocks[s] - served[s]) * rate / exact[s] for s in active])
            for s in active:
                served[s] += step * exact[s] / rate
            left -= step
        out.append(list(served))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.floats(0.01, 10) | st.sampled_from([1.0, 0.5, 2.0])), min_size=1, max_size=7))
def test_deviation_stays_below_one_block(pairs):
    blocks, weights = np.array([n for n, _ in pairs]), np.array([w for _, w in pairs])
    schedule = mixing.plan(blocks, weights)
    source = np.repeat(np.arange(len(blocks)), blocks)
    number = np.concatenate([np.arange(n) for n in blocks]) if len(source) else np.zeros(0, int)
    slot, release, deadline, phase = mixing.place(schedule, source, number)
    assert sorted(slot) == list(range(blocks.sum()))
    assert ((release <= slot) & (slot < deadline)).all()
    order, ran = source[np.argsort(slot)], [0] * len(blocks)
    for s, served in zip(order.tolist(), ideal(blocks, weights, len(order))):
        ran[s] += 1
        assert all(abs(a - b) < 1 for a, b in zip(ran, served))


def test_sources_that_end_do_not_add_up():
    """A thousand sources of one block end one after the other: the heavy source keeps to its share."""
    blocks, weights = np.array([1000] + [1] * 1000), np.array([1000.0] + [9.0] * 1000)
    order = np.argsort(mixing.plan(blocks, weights).columns[0])
    heavy = np.cumsum(order < 1000)[:1000]
    assert (abs(10 * heavy - np.arange(1, 1001)) < 10).all()
    rng = np.random.default_rng(1)
    weights[1:] *= rng.uniform(0.5, 2, 1000)  # ends at a thousand different times
    mixing.plan(blocks, weights)  # asserts that no deadline is missed


def test_given_weights_hold_while_sources_end(spark):
    sizes = {"big": 800, **{f"w{i:03}": 1 + i % 3 for i in range(300)}}
    weights = {s: (30.0 if s == "big" else 0.25 + (i % 5) / 7) for i, s in enumerate(sizes)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame([(i, s, 1, "x", 2) for i, s in rows], "doc_id long, source string, mix_slot int, MIX_POOL string, mix_name int").repartition(4)
    got = sorted(mixing.mix_order(df, weights, block=1).collect(), key=lambda r: r.slot)
    served = ideal(list(sizes.values()), [weights[s] for s in sizes], 500)
    ran = dict.fromkeys(sizes, 0)
    for r, want in zip(got, served):
        ran[r.source] += 1
        assert all(abs(ran[s] - f) < 1 for s, f in zip(sizes, want))
    out = mixing.mix(df, weights, block=1)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [r.doc_id for r in got]


def test_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 1)
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 50)
    got = mixing.mix_order(spark.range(1000).selectExpr("id doc_id", "if(id % 3 = 0, 'a', 'b') source")).collect()
    assert len({(r.source, r.block) for r in got}) == 51 and len({r.position for r in got}) == 1000


def test_mix_places_every_row_once(spark):
    rows = [(i, f"s{i % 3 if i % 2 else 0}", f"text {i}") for i in range(900)] + [(900, None, None), (900, None, None), (None, "s1", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("slot", mixing.F.lit("x")).withColumn("_rank", mixing.F.lit(0))
    weights = {"s0": 1, "s1": 2, "s2": 1}
    got = mixing.mix_order(df, weights, block=10).orderBy("position").collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((a or -1, b or "") for a, b, _ in rows)
    assert len({r.position for r in got}) == len(got)
    first = [r.source for r in got if r.phase == 0]
    half = first[: len(first) // 2]
    assert abs(half.count("s1") - 0.5 * len(half)) <= 20
    mixed = mixing.mix(df, weights, block=10)
    assert mixed.columns == df.columns
    order = [r.doc_id for r in mixed.collect()]
    assert order == [r.doc_id for r in got]
    assert mixing.mix_order(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert mixing.mix_order(df).count() == len(rows)


def test_exact_weights_over_a_long_schedule():
    blocks, weights = np.array([30_000, 30_000, 30_000, 2_000]), np.array([1.0, 1.0, 1.0, 1e-3])
    schedule = mixing.plan(blocks, weights)
    order = np.full(blocks.sum(), -1)
    source = np.repeat(np.arange(4), blocks)
    order[mixing.place(schedule, source, np.concatenate([np.arange(n) for n in blocks]))[0]] = source
    length = 90_030  # then the three equal sources end
    head, due = order[:length], np.arange(1, length + 1)[:, None] * (weights / weights.sum())
    assert len(head) > 80_000
    assert (np.abs(np.cumsum(head[:, None] == np.arange(4), axis=0) - due) < 1).all()


def test_every_source_keeps_its_own_weight(spark):
    n = 1500
    df = spark.createDataFrame([(k * n + i, f"h{i:04}") for i in range(n) for k in range(2)], "doc_id long, source string")
    weights = {f"h{i:04}": 1.0 + (i >= 1400) for i in range(n)}
    got = mixing.mix_order(df, weights, block=1).collect()
    assert len(got) == 2 * n and len({r.slot for r in got}) == 2 * n
    first = sorted(got, key=lambda r: r.slot)[:100]  # sources of twice the weight have the earliest deadlines
    assert {r.source for r in first} == {f"h{i:04}" for i in range(1400, n)}
