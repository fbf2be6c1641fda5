"""Statistics, the audit protocol and the comparison with marked texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lakeveil.functions.text import casefold, csv_safe
from lakeveil.operators.catalog import AREAS, label


def finding_stats(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, total, active, per_type): counts of a document; per_type of active ones, by label. Findings with a source
    also give added (not automatic), areas, deselected and retyped."""
    text = F.array_join(F.transform("per", lambda x: F.concat(x.label, F.lit(": "), x.a.cast("string"))), ", ")
    more = {}
    if {"source", "original_type"} <= set(findings.columns):
        more = {"added": F.col("active") & (F.col("source") != "auto"), "areas": F.col("active") & F.col("entity_type").isin(*AREAS), "deselected": ~F.col("active"), "retyped": F.col("original_type").isNotNull()}
    counts = findings.groupBy(key, label(F.col("entity_type")).alias("label")).agg(F.count("*").alias("n"), F.count_if("active").alias("a"), *[F.count_if(v).alias(k) for k, v in more.items()])
    per = F.array_sort(F.collect_list(F.when(F.col("a") > 0, F.struct((-F.col("a")).alias("o"), "label", "a"))))
    return counts.groupBy(key).agg(F.sum("n").alias("total"), F.sum("a").alias("active"), per.alias("per"), *[F.sum(k).alias(k) for k in more]).withColumn("per_type", text).drop("per")


def protocol(entries: DataFrame) -> DataFrame:
    """Rows of the audit CSV: no clear text of findings, cells no spreadsheet calculates, ordered by folded path."""
    cells = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in entries.dtypes]
    return entries.select(*cells).orderBy(casefold("rel"))


def overlap_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Rows of ``left`` with (left_semi) or without (left_anti) an overlapping row of the same kind in ``right``: an
    equi-join on document and kind with the ranges as a condition."""
    r = right.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"), F.col("entity_type").alias("__t"))
    return left.join(r, (F.col(key) == F.col("__k")) & (F.col("entity_type") == F.col("__t")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), how)


def evaluate(found: DataFrame, gold: DataFrame, key: str = "doc_id", neutral: DataFrame | None = None) -> DataFrame:
    """(entity_type, n_gold, n_hit, n_found, n_right, recall, precision) by overlap of the same kind. Findings that overlap
    a ``neutral`` place (key, start, end) and no marked one count neither as right nor as wrong."""
    if neutral is not None:
        right = overlap_join(found, gold, key, "left_semi")
        n = neutral.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
        other = overlap_join(found, gold, key, "left_anti").join(n, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_anti")
        found = right.unionByName(other)
    a = gold.groupBy("entity_type").agg(F.count("*").alias("n_gold"))
    b = overlap_join(gold, found, key, "left_semi").groupBy("entity_type").agg(F.count("*").alias("n_hit"))
    c = found.groupBy("entity_type").agg(F.count("*").alias("n_found"))
    d = overlap_join(found, gold, key, "left_semi").groupBy("entity_type").agg(F.count("*").alias("n_right"))
    out = a.join(b, "entity_type", "full").join(c, "entity_type", "full").join(d, "entity_type", "full").na.fill(0)
    share = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 4)
    return out.withColumn("recall", share("n_hit", "n_gold")).withColumn("precision", share("n_right", "n_found"))


def misses_and_false_alarms(found: DataFrame, gold: DataFrame, key: str = "doc_id", neutral: DataFrame | None = None) -> DataFrame:
    """(key, error, start, end, entity_type): the rows behind ``evaluate``. ``miss``: a marked place that no finding of its
    kind overlaps; ``false alarm``: a finding that overlaps no marked place of its kind and no ``neutral`` one."""
    spot = [key, "start", "end", "entity_type"]
    wrong = overlap_join(found.select(*spot), gold, key, "left_anti")
    if neutral is not None:
        n = neutral.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
        wrong = wrong.join(n, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_anti")
    missed = overlap_join(gold.select(*spot), found, key, "left_anti").withColumn("error", F.lit("miss"))
    return missed.unionByName(wrong.withColumn("error", F.lit("false alarm")))
