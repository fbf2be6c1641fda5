"""Centroid clustering with exact whole numbers (operator 11).

A float32 matrix product gives every vector an interval for its score against every centroid; the intervals hold all that
rounding can do. Centroids whose interval cannot be least are out; where one is left it is the nearest, where several
overlap the distances are computed in exact integers and the lowest number wins a tie. Sums are exact too: each task
adds up its vectors and hands on 32-bit limbs of the sums, which Spark adds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Scratch, arrays, as_array, fresh

CENTROIDS = 40
ROUNDS = 5
WIDTH = 64
SCALE = 256
SEED = 2
#: Vectors of one matrix product.
STEP = 4096
#: Beyond these sizes of a component, squares or sums could pass 64 bits: whole numbers of any size are used.
SMALL = 1 << 26
LONG = np.iinfo(np.int64)

SUMS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("s", pa.int64())])
NEAREST = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) for a power of two ``scale``: int64, or Python integers where a result may pass 62 bits."""
    if not x.size or np.abs(x).max() < (1 << 62) / scale:
        return np.floor(x * scale).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    for at, v in np.ndenumerate(x):
        n, d = float(v).as_integer_ratio()
        out[at] = n * scale // d
    return out


def _exact(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of row pairs; int64 where that holds them, else Python integers."""
    if v.dtype == object or c.dtype == object or max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) >= SMALL:
        d = v.astype(object) - c.astype(object)
        return (d * d).sum(axis=1) if len(d) else np.zeros(0, dtype=object)
    d = v - c
    return np.einsum("ij,ij->i", d, d)


class Nearest:
    """Nearest centroid of vectors of whole numbers."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        self.small = centroids.dtype != object and np.abs(centroids).max(initial=0) < SMALL
        if self.small:
            wide = centroids.astype(np.float64)
            self.c32 = np.ascontiguousarray(centroids.T.astype(np.float32))
            self.square = (wide * wide).sum(axis=1)  # below 2**58: rounded once in some sums, covered by the slack
            self.norm = np.sqrt(self.square)

    def scores(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(middle, slack): |c|^2 - 2 v.c lies within middle +- slack for every vector and centroid.

        Rounding both factors to float32 and adding up d products in any order, fused or not, errs by at most
        g = (d + 2) u / (1 - (d + 2) u) times the sum of |v_i c_i|, which the norms bound; u = 2**-24. Components are
        whole and small, so nothing underflows or overflows. The rest of the slack covers the double arithmetic.
        """
        d = v.shape[1]
        u = (d + 2) * 2.0**-24
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        dot = (v.astype(np.float32) @ self.c32).astype(np.float64)
        reach = norm[:, None] * self.norm[None, :]
        slack = 2 * (u / (1 - u)) * reach * (1 + 1e-6) + 1e-12 * (self.square[None, :] + 2 * reach)
        return self.square[None, :] - 2 * dot, slack

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centroid, ties to the smaller number."""
        n, k = len(v), len(self.c)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.small and v.dtype != object and np.abs(v).max(initial=0) < SMALL:
            middle, slack = self.scores(v)
            open_ = middle - slack <= (middle + slack).min(axis=1)[:, None]
        else:
            open_ = np.ones((n, k), dtype=bool)
        best = open_.argmax(axis=1)
        for row in np.array_split(np.flatnonzero(open_.sum(axis=1) > 1), max(1, n * k // STEP)):
            if len(row):
                who, which = np.nonzero(open_[row])
                dist = _exact(v[row[who]], self.c[which])
                order = np.lexsort((which, dist, who)) if dist.dtype != object else np.array(sorted(range(len(who)), key=lambda i: (who[i], dist[i], which[i])))
                first = np.flatnonzero(np.r_[True, np.diff(who[order]) > 0])
                best[row] = which[order[first]]
        return best, _exact(v, self.c[best])


def _vectors(batches, scale: int):
    """(ids, whole vectors) of Arrow batches (vec_id, e), STEP rows at most."""
    for batch in batches:
        for lo in range(0, batch.num_rows, STEP):
            part = batch.slice(lo, STEP)
            e = as_array(part.column(1)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield as_array(part.column(0)), whole(e.reshape(part.num_rows, -1), scale)


def limbs(total: int):
    """Signed 32-bit limbs of a whole number, lowest first."""
    sign, rest = (-1, -total) if total < 0 else (1, total)
    out = []
    while rest:
        out.append(sign * (rest & 0xFFFFFFFF))
        rest >>= 32
    return out


def _sum_rows(cluster: np.ndarray, v: np.ndarray, totals: dict) -> None:
    for c in np.unique(cluster).tolist():
        own = v[cluster == c]
        n, s = totals.get(c, (0, 0))
        part = own.sum(axis=0)  # STEP components below 2**51 fit 64 bits
        if own.dtype != object and np.abs(own).max(initial=0) >= 1 << 51:
            part = own.astype(object).sum(axis=0)
        totals[c] = (n + len(own), s + part.astype(object))


def _limb_rows(totals: dict):
    """(cluster, dimension, limb, value); dimension -1 counts vectors."""
    for c, (n, s) in totals.items():
        for i, total in enumerate([n, *s], start=-1):
            for j, value in enumerate(limbs(int(total))):
                yield c, i, j, value


def _sums(vectors: DataFrame, near: Nearest, width: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, exact sums)}: a row for each centroid, dimension and limb reaches the driver, whatever the data."""

    def run(batches):
        totals: dict = {}
        for _, v in _vectors(batches, scale):
            _sum_rows(near.of(v)[0], v, totals)
        rows = list(_limb_rows(totals))
        if rows:
            yield arrays(SUMS, *zip(*rows))

    out: dict = {}
    for row in vectors.mapInArrow(run, "cluster int, dim int, limb int, s long").groupBy("cluster", "dim", "limb").agg(F.sum("s").alias("s")).collect():
        out.setdefault(row.cluster, [0] * (width + 1))[row.dim + 1] += row.s << (32 * row.limb)
    return {c: (s[0], s[1:]) for c, s in out.items()}


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    wide = any(abs(x) >= 1 << 62 for r in rows for x in r)
    return np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), width)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256): the nearest centroid of every vector.

    Vectors that are null, of another length or hold a null or non-finite component are left out. The ``k`` vectors of
    the smallest sha256 of ``seed:vec_id`` start the centroids (equal ids: by their components; fewer vectors: fewer
    centroids; a vector without an id is clustered but starts none, and without any start no vector is answered).
    Repeated rows are vectors of their own. An empty cluster keeps its centroid. An empty table gives no row. Distances and sums of
    distances beyond 64 bits are cut to the largest long; assignments are exact at any size. Further columns are ignored.
    The driver holds the k centroids and k rows of sums a round.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "cluster")
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = scratch.table("vectors", vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e")).where(F.size("e") == width).where(sound))
    start = own.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256), "e").limit(k).collect()
    out_schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], out_schema)
    centroids = whole(np.array([r.e for r in start], dtype=np.float64).reshape(len(start), width), scale)
    for _ in range(rounds):
        sums = _sums(own, Nearest(centroids), width, scale)
        centroids = _matrix([[x // sums[c][0] for x in sums[c][1]] if c in sums else [int(x) for x in row] for c, row in enumerate(centroids)], width)
    near = Nearest(centroids)

    def assign(batches):
        for ids, v in _vectors(batches, scale):
            which, distance = near.of(v)
            if distance.dtype == object:
                distance = np.array([min(int(x), LONG.max) for x in distance], dtype=np.int64)
            yield arrays(NEAREST, ids, which.astype(np.int32), distance)

    named = scratch.table("assigned", own.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    totals = {r.cluster: int(r.s) for r in named.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    shas = [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in centroids]
    whole_sum = min(sum(totals.values()), int(LONG.max))
    facts = spark.createDataFrame([(c, min(t, int(LONG.max)), whole_sum, shas[c]) for c, t in sorted(totals.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return named.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows at most


def op11_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    near = """near{r} AS MATERIALIZED (
  SELECT vec_id, rn, e, best.d AS d, best.c AS c FROM (SELECT vec_id, rn, e, min({{'d': d, 'c': c}}) AS best FROM (
    SELECT v.vec_id, v.rn, v.e, m.c, CAST(list_sum(list_transform(list_zip(v.e, m.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v CROSS JOIN m{r} m) GROUP BY vec_id, rn, e)
)"""
    mean = """m{n} AS MATERIALIZED (
  SELECT m.c, coalesce(t.e, m.e) AS e FROM m{r} m LEFT JOIN (
    SELECT c, list(s ORDER BY i) AS e FROM (
      SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS s FROM (SELECT c, unnest(e) AS x, unnest(range(len(e))) AS i FROM near{r}) GROUP BY c, i) GROUP BY c) t ON t.c = m.c
)"""
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS rn, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), e) - 1 AS c, e FROM v WHERE vec_id IS NOT NULL QUALIFY c < {k}
)""",
    ]
    for r in range(rounds):
        parts += [near.format(r=r), mean.format(r=r, n=r + 1)]
    parts.append(near.format(r=rounds))
    return f"""WITH {", ".join(parts)}
SELECT n.vec_id, CAST(n.c AS INTEGER) AS cluster, n.d AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.e, ',')) AS centroid_sha256
FROM near{rounds} n JOIN m{rounds} m ON m.c = n.c"""


QUERIES = {"op11_clustering": op11_clustering}
SQL = {"op11_clustering": _sql()}
