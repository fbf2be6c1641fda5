"""From raw documents to packed training sequences: five stages, each a written table that the next one reads.

A stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the
columns of ``documents``. Near-duplicates of lines and documents are cut before sources are mixed, so that the weights
hold for what is trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeveil.llm.common import Scratch
from lakeveil.llm.lines import dedup_lines
from lakeveil.llm.mixing import mix
from lakeveil.llm.packing import pack_documents
from lakeveil.llm.quality_rules import filter_quality
from lakeveil.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go. A null or empty text has no words and goes; repeated rows are judged
    each; an empty table stays empty."""
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, ``n_chars`` follows; a document of which no word is left, all of it being repeats, goes.
    A null text stays null; equal rows are one document and get one result; an empty table stays empty."""
    out = dedup_lines(docs)
    emptied = (F.col("n_lines_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~emptied).withColumn("n_chars", F.when(F.col("n_lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; null and empty texts are one group, rows
    without an id stay, different texts under one id stay, an empty table stays empty."""
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture: each written part holds one stretch of it. Spark does not read parts in
    their order, so the next stage brings them back into it. A null source counts as an empty name; nothing is dropped."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece. The mixture is dealt again, as source and doc_id alone give it, for its order: partition p packs
    the p-th stretch, so stretches of windows by sequence_id keep the weights. A null text is packed as an
    empty one: its end mark alone."""
    return pack_documents(mix(docs))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("packing", packing)]

#: SimHash, exact union-find and tokenization are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(name, docs)
            if i:
                scratch.drop(STAGES[i - 1][0])
    return docs
