"""Documents from folders and results to folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeveil.functions.text import casefold, csv_safe, decode_text

#: Suffix: kind of document.
KINDS = {".txt": "txt", ".text": "txt", ".log": "txt", ".md": "md", ".markdown": "md"}
REDACTED = "_redacted"


def _suffix(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def _listed(spark: SparkSession, folder: str, recursive: bool, since=None) -> DataFrame:
    """Files of a folder that are documents: no hidden files or folders, no lock files, none of our own outputs. ``since``: only
    those changed then or later; the contents of others are not opened."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if since is not None:
        raw = raw.where(F.col("modificationTime") >= F.lit(since))
    root = F.lit(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath().rstrip("/") + "/")
    path = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:(//[^/]*)?(?=/)", "")
    rel = F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).otherwise(path)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), _suffix(F.col("path")))
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    out = raw.withColumn("rel", rel).withColumn("kind", kind)
    return out.where(F.col("kind").isNotNull() & ~name.startswith("~$") & ~F.col("rel").rlike(r"(^|/)\.") & ~name.rlike(rf"{REDACTED}\.[^.]+$"))


def scan_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, rel, kind, size, modified) of documents, in the order of folded paths. Contents are not read."""
    out = _listed(spark, folder, recursive).select("path", "rel", "kind", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.orderBy(casefold("rel"), "rel")


def load_documents(spark: SparkSession, folder: str, recursive: bool = True, since=None) -> DataFrame:
    """(doc_id, path, rel, kind, text, sha256, size, mtime_ns): decoded texts with one kind of line end. The id is a hash of
    the path. ``since``: a time; files that are older are passed over."""
    own = _listed(spark, folder, recursive, since)
    return own.select(F.xxhash64("path").alias("doc_id"), "path", "rel", "kind", decode_text("content").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def write_protocol(rows: DataFrame, target: str) -> None:
    """The audit CSV with a header and semicolons; cells are safe for spreadsheets. An existing one is not overwritten."""
    safe = rows.select(*[csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])
    safe.write.mode("errorifexists").option("header", True).option("sep", ";").csv(target)


def output_name(path):
    """Name of the redacted file beside a document."""
    return F.concat(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit(REDACTED), F.regexp_extract(path, r"(\.[^./]+)$", 1))
