"""A bounded sample of labelled rows with features of their texts, for the classifiers (operators 1 and 8)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import slices, text_buffer


def held_out(id_col, modulus: int, remainder: int):
    """Rows that no label is learnt from; a row without an id is none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(labels: DataFrame, label: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(doc_id, y) of at most ``most`` labelled documents, the same ones each time. Several labels of a document: their
    rounded mean. Null labels and held-out documents are left out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out("doc_id", modulus, remainder))
    return own.groupBy("doc_id").agg(F.when(F.avg("y") >= 0.5, 1).otherwise(0).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def collect_features(docs: DataFrame, labelled: DataFrame, features) -> tuple[list[bytes], np.ndarray]:
    """Features (bytes a text) and labels of the sample, one text each. ``features(raw, offsets)`` gives a list of bytes.
    The sample is bounded, so it is broadcast and its features come to the driver; texts do not."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(labelled), "doc_id").select("doc_id", "y", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                x = features(raw[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo).cast(pa.int64()), pa.array(x, pa.binary())], schema=schema)

    # several texts under one id: the one whose features come first in byte order
    rows = own.mapInArrow(run, "doc_id long, y long, x binary").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return [bytes(r.x) for r in rows], np.array([r.y for r in rows], dtype=np.int64)
