"""Centroid clustering against a plain version in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row, types as T

from lakeveil.llm.clustering import Nearest, cluster, whole

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def plain(rows, k, rounds, width, scale=256, seed=2):
    def quantised(e):
        return [(lambda n, d: n * scale // d)(*x.as_integer_ratio()) for x in e]

    kept = [(i, quantised(e)) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own: dict = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        for j, vs in own.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)) for i, v in kept] if centroids else []
    total, each = sum(d for _, d, _ in found), {}
    for _, d, j in found:
        each[j] = each.get(j, 0) + d
    most = (1 << 63) - 1
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(((i, j, min(d, most), min(each[j], most), min(total, most), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found), key=key)


def asked(spark, rows, parts=3, **how):
    df = spark.createDataFrame([Row(vec_id=i, embedding=e, cluster="mine") for i, e in rows], SCHEMA).repartition(parts)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted((tuple(r) for r in cluster(df, **how).collect()), key=key)


def test_equals_plain_version_with_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [float(i % 2), 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(200, 220)]  # ties and repeats
    rows += [rows[3], rows[3], (7, [0.5] * 6)]  # repeated rows, one id with two vectors
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [None] + [1.0] * 5), (305, [math.nan] * 6), (306, [math.inf] * 6), (None, [0.25] * 6)]
    for rounds in (0, 1, 4):
        assert asked(spark, rows, k=9, rounds=rounds, width=6) == plain(rows, 9, rounds, 6)


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([1.0, -1.0]) * rng.random() * 10.0 ** rng.choice([0, 3, 9, 17, 40, 300]) for _ in range(3)]) for i in range(60)]
    assert asked(spark, rows, k=5, rounds=3, width=3) == plain(rows, 5, 3, 3)


def test_few_and_no_vectors(spark):
    assert asked(spark, [], k=3, width=2) == []
    assert asked(spark, [(None, [1.0, 2.0])], k=3, width=2) == []
    assert asked(spark, [(4, [-0.001, 2.0])], k=3, width=2) == plain([(4, [-0.001, 2.0])], 3, 5, 2)


@pytest.mark.parametrize("size", [1 << 8, 1 << 20, (1 << 26) - 1])
def test_intervals_hold_the_exact_scores(size):
    rng = np.random.default_rng(size)
    v, c = rng.integers(-size, size + 1, (300, 64)), rng.integers(-size, size + 1, (40, 64))
    middle, slack = Nearest(c).scores(v)
    exact = (c.astype(object) ** 2).sum(axis=1)[None, :] - 2 * (v.astype(object) @ c.astype(object).T)
    off = np.abs((exact - middle.astype(object)).astype(float))
    assert (off <= slack).all()
    v[:150] = c[rng.integers(0, 40, 150)]
    v[150] = (c[3] + c[4]) // 2
    which, dist = Nearest(c).of(v)
    wide = v.astype(object), c.astype(object)
    want = [min((int(((a - b) ** 2).sum()), j) for j, b in enumerate(wide[1])) for a in wide[0]]
    assert [(int(d), int(j)) for d, j in zip(dist, which)] == want


def test_whole_is_floor():
    x = np.array([0.1, -0.1, 1e17, -1e300, 2.5])
    assert [int(i) for i in whole(x, 256)] == [(lambda n, d: n * 256 // d)(*v.as_integer_ratio()) for v in x.tolist()]
