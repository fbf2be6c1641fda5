"""Joins of ranges by buckets of positions, and the difference of two tables of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions of a bucket.
WIDTH = 1024


def _dealt(df: DataFrame, bucket: str, width: int) -> DataFrame:
    """A row for each bucket that a range touches; an empty or null range has none."""
    own = df.where(F.col("start") < F.col("end"))
    return own.withColumn(bucket, F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "r_", width: int = WIDTH) -> DataFrame:
    """All pairs of rows of equal ``keys`` whose ranges [start, end) overlap: columns of ``left``, those of ``right`` but the keys
    with ``prefix``.

    Both sides are dealt into buckets of ``width`` positions and joined by keys and bucket, so ranges of one key meet only
    where they are near; a pair counts in the bucket in which the later of both begins, so it comes out once. Null keys join
    nothing, empty ranges overlap nothing, repeated rows are rows of their own.
    """
    bucket = "__bucket"
    while bucket in left.columns + right.columns:
        bucket = "_" + bucket
    other = _dealt(right, bucket, width).select(*keys, bucket, *[F.col(c).alias(prefix + c) for c in right.columns if c not in keys])
    start, end = F.col(f"{prefix}start"), F.col(f"{prefix}end")
    pairs = _dealt(left, bucket, width).join(other, [*keys, bucket]).where((F.col("start") < end) & (start < F.col("end")))
    pairs = pairs.where(F.col(bucket) == F.floor(F.greatest("start", start) / width))
    return pairs.select(*left.columns, *[prefix + c for c in right.columns if c not in keys])


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def run_difference(before: DataFrame, after: DataFrame, key: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """(key, change, start, end, entity_type, after_start, after_end, after_type): what became of the findings of one run in
    another one, each used once.

    ``same``: range and kind are equal; ``retyped``: the range is; ``moved``: of those left, the first one of the same kind that
    it overlaps, if it is the first for that one, too; ``lost`` and ``new``: the rest, with nulls on the other side. Repeated
    findings are matched one by one. Null keys, ranges or kinds match nothing. Further columns are ignored. Both
    tables are read several times: give written ones where they are costly to make.
    """
    plain = lambda df: df.select(key, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "entity_type")
    spot = [key, "start", "end"]
    a, b = plain(before), plain(after)

    def matched(a: DataFrame, b: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Pairs by equal keys and number; what is left of either side."""
        a, b = (_numbered(x, keys, ["entity_type"]) for x in (a, b))
        other = b.select(*keys, "n", F.col("entity_type").alias("after_type"))
        both = a.join(other, [*keys, "n"]).select(key, "start", "end", "entity_type", F.col("start").alias("after_start"), F.col("end").alias("after_end"), "after_type")
        return both, a.join(b, [*keys, "n"], "left_anti").drop("n"), b.join(a, [*keys, "n"], "left_anti").drop("n")

    same, a, b = matched(a, b, [*spot, "entity_type"])
    retyped, a, b = matched(a, b, spot)
    a, b = (_numbered(x, [*spot, "entity_type"], ["entity_type"]) for x in (a, b))
    near = interval_join(a, b, [key, "entity_type"], "after_", width)
    own, others = [key, "entity_type", "start", "end", "n"], [key, "entity_type", "after_start", "after_end", "after_n"]
    near = near.withColumn("i", F.row_number().over(Window.partitionBy(*own).orderBy(*others[2:]))).withColumn("j", F.row_number().over(Window.partitionBy(*others).orderBy(*own[2:])))
    near = near.where("i = 1 and j = 1").drop("i", "j")
    moved = near.select(key, "start", "end", "entity_type", "after_start", "after_end", F.col("entity_type").alias("after_type"))
    lost = a.join(near.select(*own), own, "left_anti")
    new = b.select(key, "entity_type", *[F.col(c).alias(f"after_{c}") for c in ("start", "end", "n")]).join(near.select(*others), others, "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    lost = lost.select(key, "start", "end", "entity_type", none("int").alias("after_start"), none("int").alias("after_end"), none("string").alias("after_type"))
    new = new.select(key, none("int").alias("start"), none("int").alias("end"), none("string").alias("entity_type"), "after_start", "after_end", F.col("entity_type").alias("after_type"))
    parts = [x.withColumn("change", F.lit(c)) for c, x in (("same", same), ("retyped", retyped), ("moved", moved), ("lost", lost), ("new", new))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def difference_counts(difference: DataFrame) -> DataFrame:
    """(entity_type, same, retyped, moved, lost, new): what changed by kind, that of the earlier run where it has one."""
    kind: Column = F.coalesce("entity_type", "after_type").alias("entity_type")
    return difference.groupBy(kind).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("same", "retyped", "moved", "lost", "new")])
