"""Distributed union-find: connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Scratch


def joined_somewhat(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b), for a first view between rounds: equal roots are connected,
    but not all that is connected has equal roots. Each node takes the least of what its neighbours know, so stars come out
    whole."""
    now = edges.where("a <> b").distinct()
    both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, both.b == least.n).groupBy(F.col("a").alias("node")).agg(F.min("m").alias("root"))


def connected_components(scratch: Scratch, edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b); root is the smallest node of the component.

    Each round attaches the larger neighbours of a node, then its smaller ones, to the smallest node known; the edge
    table never grows and ends as stars. Every round is a written table, so a lost executor costs a part of one round.
    The driver sees two numbers a round. Hot nodes are pre-aggregated (min) before the shuffle, and the joins are plain
    equi-joins that adaptive execution can split. Self-loops and repeated edges are allowed, null nodes are dropped.
    """
    now = scratch.table(f"{label}-0", edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for k in range(1, most_rounds + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = now.join(least, now.b == least.n).select("a", F.col("m").alias("b")).distinct()  # a > b: a is the larger neighbour of b
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, large.a == least.n).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = scratch.table(f"{label}-{k}", small.where("a <> b").distinct(), free=False)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{k - 1}")
        now = after
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
