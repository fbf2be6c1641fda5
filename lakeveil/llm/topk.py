"""Exact top-k search by inner product (operator 6).

Columnar branch-and-bound: vectors stand dimension by dimension; scores grow one block of dimensions at a time; after each
block the mass that is left in query and candidate (Cauchy-Schwarz) bounds the final score, and candidates that cannot
reach the k-th best any more are compacted away. The stated query set goes against all rows in tiles: vectors are packed into
blocks once, a group of query blocks meets a group of candidate blocks in one task, and an aggregation keeps the best of
each query's tiles. No vector passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lakeveil.llm.common import Scratch, arrays

K = 5
EVERY = 50
SCALE = 256
#: Queries that a tile holds at once, about; fewer where their components come to more than GROUP_CELLS.
QUERY_BLOCK = 16384
GROUP_CELLS = 1 << 21
#: Candidates that a tile reads, about, block by block.
CANDIDATES = 1 << 18
#: Vectors and components of a packed block, at most (one vector is never cut).
BLOCK_ROWS = 1024
BLOCK_CELLS = 1 << 17
#: Candidates of one width that are searched at once, about; fewer where their components come to more than GROUP_CELLS.
CHUNK = 16384
#: Dimensions added between two prunings.
DIMS = 8

LONG = np.iinfo(np.int64)
#: Scores as three whole numbers, the first signed, of 48 bits below it: in their order they sort as the score does.
LIMB = 48
PACKED = pa.schema([("query", pa.bool_()), ("width", pa.int32()), ("n", pa.int32()), ("bytes", pa.int32()), ("ids", pa.binary()), ("cells", pa.binary())])
PACKED_DDL = "query boolean, width int, n int, bytes int, ids binary, cells binary"
HITS = pa.schema([("block", pa.int64()), ("i", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("high", pa.int64()), ("middle", pa.int64()), ("low", pa.int64())])
HITS_DDL = "block long, i int, query_id long, vec_id long, score long, high long, middle long, low long"
OUT = "query_id long, rank int, vec_id long, score long"


def best(scores, ids, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in order."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k], dtype=np.int64)
    return np.lexsort((ids, -scores))[:k]


class Search:
    """The k best candidates of each query over all chunks given to ``add``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K, dims: int = DIMS):
        self.ids, self.q, self.k, self.dims = ids, vectors, k, dims
        self.scores = [np.zeros(0, np.int64) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]

    def keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores[i], scores), np.append(self.found[i], ids)
        top = best(scores, ids, self.k)
        self.scores[i], self.found[i] = scores[top], ids[top]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        n, width = vectors.shape
        if not n or not len(self.q):
            return
        largest = float(max(1.0, np.abs(self.q.astype(float)).max(initial=0))) * float(max(1.0, np.abs(vectors.astype(float)).max(initial=0))) * max(1, width)
        if largest >= 2**52:  # beyond what doubles hold exactly: whole numbers of any size, no pruning
            c = vectors.astype(object)
            for i, q in enumerate(self.q.astype(object)):
                other = ids != self.ids[i]
                self.keep(i, np.array([int(x) for x in c[other] @ q] + [None], dtype=object)[:-1], ids[other])
            return
        mass = (vectors.astype(float) ** 2).sum(axis=0)
        order = np.argsort(-mass)  # dimensions of much mass first
        column = np.ascontiguousarray(vectors[:, order].T.astype(float))
        q = self.q[:, order].astype(float)
        blocks = [slice(a, min(a + self.dims, width)) for a in range(0, width, self.dims)] or [slice(0, 0)]
        left_c = [np.sqrt((column[b.stop :] ** 2).sum(axis=0)) for b in blocks]
        left_q = np.stack([np.sqrt((q[:, b.stop :] ** 2).sum(axis=1)) for b in blocks])
        for lo in range(0, len(q), 256):
            first = q[lo : lo + 256, blocks[0]] @ column[blocks[0]]
            for i in range(lo, min(lo + 256, len(q))):
                alive = np.flatnonzero(ids != self.ids[i])
                partial = first[i - lo][alive]
                for b, block in enumerate(blocks):
                    if b:
                        partial = partial + q[i, block] @ column[block][:, alive]
                    if block.stop == width:
                        break
                    reach = left_q[b, i] * left_c[b][alive]
                    reach += 1e-9 * (1 + reach)
                    floor = np.nextafter(float(self.scores[i][-1]), -np.inf) if len(self.scores[i]) == self.k else -np.inf
                    if len(alive) > self.k:
                        floor = max(floor, np.partition(partial - reach, len(alive) - self.k)[len(alive) - self.k])
                    stay = partial + reach >= floor
                    if not stay.all():
                        alive, partial = alive[stay], partial[stay]
                if len(alive):
                    self.keep(i, partial.astype(np.int64), ids[alive])

def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, e): whole components of the vectors that take part."""
    e = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    df = vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and e is not null").where(sound)
    return df.select("vec_id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("e"))


def _by_width(ids: np.ndarray, lists: pa.Array):
    """(ids, matrix) for each length of vector."""
    width = np.diff(lists.offsets.to_numpy())
    values, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        yield int(w), ids[rows], values[at[rows][:, None] + np.arange(w)]


def _pack(every: int):
    """Vectors (vec_id, e) into blocks of one width; those that are queries, too, once more into blocks of queries."""

    def run(batches):
        for batch in batches:
            for w, ids, c in _by_width(batch.column(0).to_numpy(), batch.column(1)):
                for query in (False, True):
                    own = np.flatnonzero(ids % every == 0) if query else np.arange(len(ids))
                    step = max(1, min(BLOCK_ROWS, BLOCK_CELLS // max(1, w)))
                    for lo in range(0, len(own), step):
                        part = own[lo : lo + step]
                        cells = c[part]
                        size = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not cells.size or (np.iinfo(t).min <= cells.min() and cells.max() <= np.iinfo(t).max))
                        yield arrays(PACKED, [query], [w], [len(part)], [np.dtype(size).itemsize], [ids[part].astype("<i8").tobytes()], [cells.astype(size).tobytes()])

    return run


def _limbs(score: int) -> tuple[int, ...]:
    """The score cut to 64 bits, and its three limbs."""
    return min(max(score, LONG.min), LONG.max), score >> 2 * LIMB, (score >> LIMB) & ((1 << LIMB) - 1), score & ((1 << LIMB) - 1)


def _search(k: int):
    """Rows of a tile in order, its query blocks before its candidate blocks: the best candidates of each query in it."""

    def search(state: list) -> None:
        if state[2]:
            state[1].add(np.concatenate([x[0] for x in state[2]]), np.concatenate([x[1] for x in state[2]]))
            state[2] = []

    def flush(found: dict):
        rows = []
        for state in found.values():
            search(state)
            origin, s, _ = state
            for i, (scores, ids) in enumerate(zip(s.scores, s.found)):
                rows += [(*origin[i], int(s.ids[i]), v, *_limbs(int(x))) for x, v in zip(scores.tolist(), ids.tolist())]
        if rows:
            yield arrays(HITS, *zip(*rows))

    def run(batches):
        tile, queries, found = None, {}, {}
        for batch in batches:
            for row in range(batch.num_rows):
                t, block, query, w, n, size, ids, cells = (c[row].as_py() for c in batch.columns)
                if t != tile:
                    yield from flush(found)
                    tile, queries, found = t, {}, {}
                ids = np.frombuffer(ids, dtype="<i8")
                cells = np.frombuffer(cells, dtype=f"i{size}").reshape(n, w).astype(np.int64)
                if query:
                    queries.setdefault(w, []).append((block, ids, cells))
                elif w in queries:
                    if w not in found:
                        origin = [(b, i) for b, own, _ in queries[w] for i in range(len(own))]
                        found[w] = [origin, Search(np.concatenate([x[1] for x in queries[w]]), np.concatenate([x[2] for x in queries[w]]), k), []]
                    found[w][2].append((ids, cells))
                    waiting = sum(len(x[0]) for x in found[w][2])
                    if waiting >= CHUNK or waiting * w >= GROUP_CELLS:
                        search(found[w])
        yield from flush(found)

    return run


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, query_block: int = QUERY_BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every row whose id is divisible by ``every``.

    Rows with a null id, a null vector or a null or non-finite component take no part. Vectors are compared with those
    of their own length (an empty one with empty ones, score 0). Rows that share the query's id are its own and no
    candidates of it; a query row that stands twice is answered twice. Ranks follow the exact scores of the whole components;
    components and given scores beyond 64 bits are cut to that range. No candidate, or an empty table: no row. Further columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    packed = quantised(vectors, id_col, vec_col, scale).mapInArrow(_pack(every), PACKED_DDL)
    blocks = scratch.table("blocks", packed.select(F.monotonically_increasing_id().alias("block"), "*"))
    total = {r.query: r for r in blocks.groupBy("query").agg(F.count("*").alias("blocks"), F.sum("n").alias("n"), F.sum(F.col("n").cast("long") * F.col("width")).alias("cells")).collect()}
    if True not in total:
        return spark.createDataFrame([], OUT)
    ask, have = total[True], total[False]
    n_q = max(1, min(ask.blocks, max(-(-ask.n // query_block), -(-ask.cells // GROUP_CELLS))))
    # few tiles: as many as there are cores, so that none is idle
    n_c = max(1, min(have.blocks, max(-(-have.n // CANDIDATES), -(-spark.sparkContext.defaultParallelism // n_q))))
    group = lambda n: F.pmod(F.xxhash64("block"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = blocks.where("query").withColumn("c", each(n_c)).withColumn("q", group(n_q))
    offered = blocks.where("not query").withColumn("q", each(n_q)).withColumn("c", group(n_c))
    tiles = asked.unionByName(offered).select((F.col("q") * n_c + F.col("c")).cast("int").alias("tile"), *blocks.columns)
    # a task for each tile; a tile's rows are read as a stream
    tiles = tiles.repartitionById(n_q * n_c, "tile").sortWithinPartitions("tile", F.desc("query"), "block")
    hits = scratch.table("hits", tiles.mapInArrow(_search(k), HITS_DDL))
    order = Window.partitionBy("block", "i").orderBy(F.desc("high"), F.desc("middle"), F.desc("low"), "vec_id")
    best_of = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best_of.select("query_id", "rank", "vec_id", "score")


def op6_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op6_topk": op6_topk}
SQL = {
    "op6_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}
