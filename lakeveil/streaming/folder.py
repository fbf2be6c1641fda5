"""Redaction of documents as they arrive: a file stream of a documents table, with the same row-wise operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeveil.operators.detect import Settings, detect
from lakeveil.operators.redact import redact


def redact_stream(spark: SparkSession, folder: str, schema, settings: Settings | None = None) -> DataFrame:
    """Streaming DataFrame of redacted documents; stateless, so any sink and output mode append works."""
    s = settings or Settings()
    return redact(detect(spark.readStream.schema(schema).parquet(folder), s), s.mode).drop("findings", "segments", "text")


def start(stream: DataFrame, target: str, checkpoint: str):
    """Append to Parquet, exactly once; what is there is worked off, then the query ends."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
