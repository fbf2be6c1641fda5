"""A folder of documents from end to end: what is new is analysed, held back or written redacted, and the state is saved.

A run writes its redacted documents into a folder of its own below ``target`` and takes effect with the snapshot of the
state that names it: readers join the rows with the state by path, run and content hash. So a run that is cut off anywhere
changes nothing, and a document has one row at most, that of its present content.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeveil.operators import verify, workspace as w
from lakeveil.operators.detect import Settings, detect, findings_table
from lakeveil.operators.redact import redact
from lakeveil.sources.files import load_documents, output_name, scan_folder

STATE = "rel string, status string, size long, mtime_ns long, sha256 string, text_sha string, findings array<struct<s:int,e:int,t:string,sc:double,rec:string,a:boolean,src:string>>, note string, run int"


@dataclass
class Run:
    code: int
    state: DataFrame
    written: DataFrame  # (rel, name, redacted_text) of this run


def _sweep(spark: SparkSession, target: str, state_dir: str) -> None:
    """What runs left that were cut off: texts they worked on, and rows that no snapshot names."""
    fs, path = w._fs(spark, state_dir)
    for x in fs.listStatus(path) if fs.exists(path) else []:
        if x.getPath().getName().startswith("work-"):
            fs.delete(x.getPath(), True)
    last = w.last_whole(spark, state_dir)
    for n in w.numbered(spark, target, "run="):
        if last is None or n > last:
            w.drop(spark, f"{target}/run={n:09d}")


def _to_read(listing: DataFrame, before: DataFrame) -> DataFrame:
    """(rel, modified) of files that are new, look changed, or were not finished."""
    old = before.select("rel", "status", F.col("size").alias("o_size"), F.col("mtime_ns").alias("o_mtime"))
    j = listing.join(old, "rel", "left")
    same = F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime_ns").eqNullSafe(F.col("o_mtime"))
    return j.where(F.col("status").isNull() | ~same | F.col("status").isin(w.WAITING, w.ERROR, w.MISSING)).select("rel", "modified")


def run_folder(spark: SparkSession, source: str, target: str, state_dir: str, settings: Settings | None = None) -> Run:
    """Work off a folder of texts. Documents that are done and unchanged are skipped, by size and time, without opening
    them; one whose values stand again outside of findings is held back (code 3); the others are written redacted and their
    leftovers counted (code 2). The folder is listed once and a content is read once: what is recorded is the hash of what
    was analysed. Texts in clear are kept for the time of the run only. One run at a time works on a state.
    """
    s = settings or Settings()
    _sweep(spark, target, state_dir)
    loaded = w.load(spark, state_dir)
    before = loaded if loaded is not None else spark.createDataFrame([], STATE)
    if "run" not in before.columns:
        before = before.withColumn("run", F.lit(None).cast("int"))
    number = w.next_number(spark, state_dir)
    work, out = f"{state_dir}/work-{number:09d}", f"{target}/run={number:09d}"

    def table(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        listing = table("listing", scan_folder(spark, source).select("rel", "size", "modified", (F.unix_micros("modified") * 1000).alias("mtime_ns")))
        wanted = table("wanted", _to_read(listing, before))
        since = wanted.agg(F.min("modified")).first()[0]
        docs = load_documents(spark, source, since=since).join(wanted.select("rel"), "rel", "left_semi") if since else load_documents(spark, source).limit(0)
        docs = table("docs", docs.select("doc_id", "rel", "path", "text", "size", "mtime_ns", "sha256"))
        known = listing.join(docs.select("rel"), "rel", "left_anti").join(before.select("rel", "sha256"), "rel", "left").select("rel", "size", "mtime_ns", F.coalesce("sha256", F.lit("")).alias("sha256"))
        diff = table("diff", w.snapshot_diff(docs.select("rel", "size", "mtime_ns", "sha256").unionByName(known), before))
        todo = diff.where("todo").select("rel")
        found = table("found", detect(docs.join(todo, "rel", "left_semi").select("doc_id", "rel", "path", "text"), s))

        status = verify.hold_back(found).select("doc_id", "status")
        free = found.join(status.where(F.col("status") == "auto").select("doc_id"), "doc_id", "left_semi")
        redacted = table("redacted", redact(free, s.mode).select("doc_id", "rel", output_name("rel").alias("name"), "findings", "segments", "redacted_text"))
        left = verify.leftovers(redacted).groupBy("doc_id").agg(F.sum("n").alias("n_left"))
        redacted.join(docs.select("rel", "sha256"), "rel").select("rel", "name", "sha256", "redacted_text").write.mode("overwrite").parquet(out)

        note = F.when(F.col("own") == w.TO_REVIEW, F.lit("held back: values stand again outside of findings")).when(F.col("n_left") > 0, F.format_string("%d leftovers", F.col("n_left")))
        new = found.join(status.withColumnRenamed("status", "own"), "doc_id").join(left, "doc_id", "left")
        new = new.select("rel", "own", F.sha2("text", 256).alias("text_sha"), w.compact(F.col("findings")).alias("findings"), note.alias("note"), F.when(F.col("own") == w.AUTO, F.lit(number)).alias("run"))
        old = before.select("rel", *[F.col(c).alias(f"o_{c}") for c in ("text_sha", "findings", "note", "run")])
        after = diff.join(new, "rel", "left").join(old, "rel", "left")
        fresh = F.col("own").isNotNull()
        pick = [F.when(fresh, F.col(c)).otherwise(F.col(f"o_{c}")).alias(c) for c in ("text_sha", "findings", "note", "run")]
        w.save(after.select("rel", F.when(fresh, F.col("own")).otherwise(F.col("status")).alias("status"), "size", "mtime_ns", "sha256", *pick), state_dir)
    finally:
        w.drop(spark, work)
    code = F.when(F.col("note").endswith("leftovers"), 2).when(F.col("status") == w.ERROR, 1).when(F.col("status") == w.TO_REVIEW, 3).otherwise(0)
    state = w.load(spark, state_dir)
    return Run(verify.worst(state.select(code.alias("code"))).first().code, state, spark.read.parquet(out).select("rel", "name", "redacted_text"))


def redacted_documents(spark: SparkSession, target: str, state: DataFrame) -> DataFrame:
    """(rel, name, redacted_text): one row for each document that the state says is written, as its content is now."""
    rows = spark.read.schema("rel string, name string, sha256 string, redacted_text string, run int").option("basePath", target).parquet(target)
    now = state.where((F.col("status") == w.AUTO) & F.col("run").isNotNull()).select("rel", "run", "sha256")
    return rows.join(now, ["rel", "run", "sha256"]).select("rel", "name", "redacted_text")


def findings_of(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of the stored findings of documents (rel, doc_id, text), with their texts; none where the text has changed."""
    j = docs.join(state.select("rel", "text_sha", F.col("findings").alias("stored")), "rel")
    return findings_table(j.withColumn("findings", w.restore(F.col("stored"), F.col("text"), F.col("text_sha"))))
