"""Mixing sources to target weights by Pfair scheduling (operator 5).

Documents of a source are dealt into blocks. The ideal mixture serves all sources at once, each at its weight's share of
those that have not ended; block j of a source is released at the slot in which the ideal begins it and due by the slot in
which the ideal ends it. Every slot takes the released block with the earliest deadline. The ideal itself meets all
deadlines, and for unit blocks with whole releases and deadlines the earliest deadline then does, too: at no slot is any
source a whole block ahead of or behind the ideal, however many sources have ended before. Weights are exact: the
integers over one power of two that the floats are.

The driver schedules blocks, not documents: a block is a fixed share of the corpus (BLOCK documents at least), so there are at
most MOST_BLOCKS of them and one more for each source. The schedule is a table that documents are joined with.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lakeveil.llm.common import Scratch, fresh

#: Documents of a block, at least.
BLOCK = 64
#: Blocks of the whole corpus, beside one for each source that a last block is short in.
MOST_BLOCKS = 1 << 20
#: Default weights: shares of the corpus to this power, so that small sources are raised.
TEMPERATURE = 0.5
#: Documents of a source that are ranked in one group, and groups that are added up in one.
GROUP, GROUPS = 2_000, 4_096
_FAR = (1 << 63) - 1


def integers(weights: np.ndarray) -> list[int]:
    """Positive finite floats as integers in exactly the same proportion."""
    pairs = [float(w).as_integer_ratio() for w in weights]
    most = max((d for _, d in pairs), default=1)
    return [n * (most // d) for n, d in pairs]


class Schedule:
    """By source and block the columns slot, release, deadline and phase (sources that end before the block is due);
    source s starts at first[s]."""

    def __init__(self, blocks: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
        self.columns = tuple(np.zeros(self.first[-1], dtype=np.int64) for _ in range(4))


def _by_end(size: list[int], exact: list[int], weights: np.ndarray) -> tuple[list[int], list[float]]:
    """Sources with blocks in the order in which the ideal ends them, and about when, in blocks over weight."""
    ends = {s: n / float(weights[s]) for s, n in enumerate(size) if n}
    order, at = sorted(ends, key=lambda s: (ends[s], s)), 0
    while at < len(order):  # what floats hardly tell apart is put in order exactly
        to = at + 1
        while to < len(order) and ends[order[to]] <= ends[order[to - 1]] * (1 + 1e-12):
            to += 1
        if to - at > 1:
            order[at:to] = sorted(order[at:to], key=lambda s: (Fraction(size[s], exact[s]), s))
        at = to
    return order, [ends[s] for s in order]


def plan(blocks: np.ndarray, weights: np.ndarray) -> Schedule:
    """Schedule of all blocks of all sources; weights are positive floats."""
    size, exact, out = blocks.astype(np.int64).tolist(), integers(weights), Schedule(blocks)
    slots, releases, deadlines, phases = out.columns
    first = out.first.tolist()
    order, ends = _by_end(size, exact, weights)
    rank = {s: i for i, s in enumerate(order)}
    # before order[i] ends, sources of weight left[i] run, and done[i] blocks are of sources that have ended
    left, done = [0] * len(order), [0] * len(order)
    total, over = sum(exact[s] for s in order), 0
    for i, s in enumerate(order):
        left[i], done[i] = total, over
        total, over = total - exact[s], over + size[s]

    def ideal(s: int, n: int) -> tuple[int, int, int]:
        """Slots in which the ideal has served n blocks of s, rounded down and up, and the phase."""
        w = exact[s]
        i = min(bisect_left(ends, n / float(weights[s]) * (1 - 1e-12)), rank[s])
        while i < rank[s] and n * exact[order[i]] > size[order[i]] * w:
            i += 1
        whole = done[i] + n * left[i] // w
        return whole, whole + (n * left[i] % w > 0), i

    ready, waiting = [], []  # (deadline, source, block, release, what the next one is released at, phase); the same by release
    for s in order:
        down, up, i = ideal(s, 1)
        ready.append((up, s, 0, 0, down, i))
    heapq.heapify(ready)
    for t in range(first[-1]):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1])
        deadline, s, j, release, after, phase = heapq.heappop(ready)
        assert release <= t < deadline, "a deadline was missed"
        at = first[s] + j
        slots[at], releases[at], deadlines[at], phases[at] = t, release, min(deadline, _FAR), phase
        if j + 1 < size[s]:
            down, up, i = ideal(s, j + 2)
            heapq.heappush(waiting, (after, (up, s, j + 1, after, down, i)))
    return out


def place(schedule: Schedule, source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, ...]:
    """(slot, release, deadline, phase) of block numbers (from 0) of sources."""
    at = schedule.first[source] + block
    return tuple(c[at] for c in schedule.columns)


NAMES = ("pool", "rank", "block", "slot", "release", "deadline", "phase")


def _scheduled(docs: DataFrame, weights: dict[str, float] | None, block: int | None, seed: int) -> tuple[DataFrame, dict[str, str], int, int]:
    """``docs`` with columns for NAMES, what these are called, the number of slots, the documents of a block."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    counts = docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).toArrow()
    pools = sorted(zip(counts.column("s").to_pylist(), counts.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    sizes = np.array([n for _, n in pools], dtype=np.int64)
    block = block or max(BLOCK, -(-int(sizes.sum()) // MOST_BLOCKS))
    if weights is None:
        share = sizes.astype(float) ** TEMPERATURE
    else:
        share = np.array([weights.get(s, 0.0) for s, _ in pools], dtype=float)
        if (share < 0).any() or not np.isfinite(share).all():
            raise ValueError("weights must be finite and not negative")
        # sources without a weight share what the smallest weight has, by their sizes, so that nothing is dropped
        none = share <= 0
        if none.any():
            share[none] = (share[~none].min() if (~none).any() else 1.0) * sizes[none] / sizes[none].sum()
    blocks = -(-sizes // block)
    schedule = plan(blocks, share)
    slots = int(blocks.sum())

    extra = fresh(docs, *[f"mix_{x}" for x in (*NAMES, "name", "groups", "key", "group", "outer", "n", "before", "within")])
    own = dict(zip((*NAMES, "name", "groups", "key", "group", "outer", "n", "before", "within"), extra))
    c = {k: F.col(v) for k, v in own.items()}
    # written tables: Spark knows their size and broadcasts them only if they are small
    known = pa.table({own["name"]: pa.array([s for s, _ in pools], pa.string()), own["pool"]: pa.array(np.arange(len(pools)), pa.int32()), own["groups"]: pa.array(np.maximum(1, -(-sizes // GROUP)), pa.int32())})
    known = scratch.table("sources", spark.createDataFrame(known, f"{own['name']} string, {own['pool']} int, {own['groups']} int"))
    timed = pa.table({own["pool"]: pa.array(np.repeat(np.arange(len(pools)), blocks), pa.int32()), own["block"]: pa.array(np.arange(slots) - np.repeat(schedule.first[:-1], blocks), pa.int64())} | {own[k]: pa.array(v, pa.int64()) for k, v in zip(NAMES[3:], schedule.columns)})
    timed = scratch.table("schedule", spark.createDataFrame(timed, ", ".join([f"{own['pool']} int", *[f"{own[k]} long" for k in NAMES[2:]]])))

    keyed = docs.withColumn(own["name"], name).join(known, own["name"])
    keyed = keyed.withColumn(own["key"], F.xxhash64(F.lit(seed), "doc_id", own["name"])).withColumn(own["group"], F.pmod(F.shiftrightunsigned(c["key"], 1), c["groups"]).cast("int"))
    # documents before a group: those of earlier stretches of groups and of earlier groups of its stretch
    dealt = keyed.groupBy(own["pool"], own["group"]).agg(F.count("*").alias(own["n"])).withColumn(own["outer"], F.floor(c["group"] / GROUPS))
    below = Window.unboundedPreceding, -1
    outer = dealt.groupBy(own["pool"], own["outer"]).agg(F.sum(own["n"]).alias(own["n"]))
    outer = outer.select(own["pool"], own["outer"], F.coalesce(F.sum(own["n"]).over(Window.partitionBy(own["pool"]).orderBy(own["outer"]).rowsBetween(*below)), F.lit(0)).alias(own["before"]))
    inner = F.coalesce(F.sum(own["n"]).over(Window.partitionBy(own["pool"], own["outer"]).orderBy(own["group"]).rowsBetween(*below)), F.lit(0))
    dealt = dealt.withColumn(own["within"], inner).join(outer, [own["pool"], own["outer"]]).select(own["pool"], own["group"], (c["before"] + c["within"]).alias(own["before"]))
    rank = F.row_number().over(Window.partitionBy(own["pool"], own["group"]).orderBy(own["key"], "doc_id"))
    ranked = keyed.withColumn(own["rank"], rank).join(dealt, [own["pool"], own["group"]]).withColumn(own["rank"], c["before"] + c["rank"] - 1)
    ranked = ranked.withColumn(own["block"], F.floor(c["rank"] / block)).select(*docs.columns, own["pool"], own["rank"], own["block"])
    return ranked.join(timed, [own["pool"], own["block"]]), own, slots, block


def mix_order(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, block, slot, position, release, deadline, phase) for every row of ``docs``.

    ``slot`` orders the blocks of the mixture; ``position`` orders the documents (slot times block size plus the place in
    the block: only the last block of a source can be short, so numbers may be left out). Every row is placed exactly
    once; nothing is repeated or dropped. ``weights``: target weight by source, any positive scale; default: share of
    the corpus to the power TEMPERATURE. A null source counts as an empty name; sources without a weight share the
    smallest one. Every source is scheduled by itself; the driver holds their names. ``block``: documents of a block, see
    above. Within a source the order is pseudo-random by ``seed`` and doc_id; repeated rows stand one after the other. An
    empty table gives an empty result; null texts and further columns, whatever their names, do not matter.
    """
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"))
    placed, own, _, block = _scheduled(keys, weights, block, seed)
    c = {k: F.col(v) for k, v in own.items()}
    return placed.select("doc_id", "source", c["block"].alias("block"), c["slot"].alias("slot"), (c["slot"] * block + c["rank"] % block).alias("position"), c["release"].alias("release"), c["deadline"].alias("deadline"), c["phase"].cast("int").alias("phase"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int | None = None, seed: int = 0) -> DataFrame:
    """All rows of ``docs`` in the order of the mixture: partition p holds the p-th stretch of slots, in order. Columns and their
    names stay, whatever they are."""
    placed, own, slots, _ = _scheduled(docs, weights, block, seed)
    n = max(1, min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), slots))
    shard = F.floor(F.col(own["slot"]) * n / max(1, slots)).cast("int")
    return placed.repartitionById(n, shard).sortWithinPartitions(own["slot"], own["rank"]).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_order(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_mixing": op5_mixing}
SQL: dict[str, str] = {}
