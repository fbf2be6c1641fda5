"""The state of a folder of documents between runs, as tables: differences, statuses, persisted findings without text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakeveil.functions.text import casefold

WAITING, TO_REVIEW, REVIEWED, AUTO, ERROR, MISSING = "waiting", "to_review", "reviewed", "auto", "error", "missing"


def snapshot_diff(disk: DataFrame, state: DataFrame) -> DataFrame:
    """(rel, status, change, todo, size, mtime_ns, sha256) from the files there are (rel, size, mtime_ns, sha256) and the
    recorded ones (with status). Size and time decide whether the hash is compared; the hash decides whether it is new.
    A file that comes back with another time but the same hash waits for the next run."""
    d = disk.select("rel", *[F.col(c).alias(f"d_{c}") for c in ("size", "mtime_ns", "sha256")], F.lit(True).alias("here"))
    s = state.select("rel", "status", "size", "mtime_ns", "sha256", F.lit(True).alias("known"))
    j = d.join(s, "rel", "full_outer")
    here, known = F.col("here").isNotNull(), F.col("known").isNotNull()
    now = F.when(F.col("status") == MISSING, WAITING).otherwise(F.col("status"))
    touched = ~(F.col("d_size").eqNullSafe(F.col("size")) & F.col("d_mtime_ns").eqNullSafe(F.col("mtime_ns")))
    same = (F.col("d_sha256") == F.col("sha256")) & (F.col("sha256") != "")
    changed = touched & ~F.coalesce(same, F.lit(False))
    change = F.when(~known, "new").when(~here & (F.col("status") == MISSING), "still_missing").when(~here, "missing").when(changed, "changed").when(touched, "touched").otherwise("same")
    status = F.when(~known | changed & here, WAITING).when(~here, MISSING).otherwise(now)
    todo = F.when(~here, False).when(~known, True).when(touched, changed).otherwise(now.isin(WAITING, ERROR))
    keep = lambda c: F.when(here, F.col(f"d_{c}")).otherwise(F.col(c)).alias(c)
    return j.select("rel", status.alias("status"), change.alias("change"), todo.alias("todo"), keep("size"), keep("mtime_ns"), keep("sha256"))


def next_status(status: Column, event: Column) -> Column:
    """Status after an event: analysed, failed, edited, held, exported_human, exported_auto, text_changed."""
    return (
        F.when((event == "analysed") & status.isin(WAITING, ERROR), TO_REVIEW)
        .when(event == "failed", ERROR)
        .when((event == "edited") & status.isin(REVIEWED, AUTO), TO_REVIEW)
        .when(event == "exported_human", REVIEWED)
        .when(event == "exported_auto", AUTO)
        .when(event == "text_changed", WAITING)
        .otherwise(status)
    )


def compact(findings: Column) -> Column:
    """Findings as they are stored: positions, kind, score, state and recognizer, never the text."""
    return F.transform(findings, lambda f: F.struct(f.start.alias("s"), f.end.alias("e"), f.entity_type.alias("t"), f.score.alias("sc"), f.recognizer.alias("rec"), f.active.alias("a"), f.source.alias("src")))


def restore(stored: Column, text: Column, text_sha: Column | None = None) -> Column:
    """Stored findings with their texts; positions outside of the text are passed over. With the SHA-256 that the text had
    when they were stored: none of them if it has changed."""
    good = F.filter(stored, lambda f: (f.s >= 0) & (f.s < f.e) & (f.e <= F.length(text)))
    out = F.transform(good, lambda f: F.struct(f.s.alias("start"), f.e.alias("end"), f.t.alias("entity_type"), F.substring(text, f.s + 1, f.e - f.s).alias("text"), f.sc.alias("score"), f.rec.alias("recognizer"), F.lit(False).alias("ner"), f.src.alias("source"), f.a.alias("active")))
    return out if text_sha is None else F.when(F.sha2(text, 256) == text_sha, out).otherwise(F.filter(out, lambda f: F.lit(False)))


def apply_edits(findings: DataFrame, edits: DataFrame, order: str | None = None) -> DataFrame:
    """Findings (id, doc_id, start, end, entity_type, active, source) after edits (id, action, entity_type): toggle,
    activate, deactivate, remove, retype. Several edits of a finding take effect in the order of the column ``order``, a
    finding stays one row; without it only their number and last kind by name are certain, so give it. The first retype of
    an automatic finding keeps its original kind."""
    by = F.col(order) if order else F.lit(0)
    folded = edits.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(by.alias("o"), F.col("action").alias("action"), F.col("entity_type").alias("kind")))).alias("__edits"))  # of one finding
    j = findings.join(folded, "id", "left")
    old = F.col("original_type") if "original_type" in findings.columns else F.lit(None).cast("string")
    kinds = F.filter("__edits", lambda e: e.action == "retype")
    switch = lambda state, e: F.when(e.action == "toggle", ~state).when(e.action == "activate", True).when(e.action == "deactivate", False).otherwise(state)
    changed = F.coalesce(F.size(kinds), F.lit(0)) > 0
    j = j.withColumn("original_type", F.when(changed & old.isNull() & (F.col("source") == "auto"), F.col("entity_type")).otherwise(old))
    j = j.withColumn("active", F.coalesce(F.aggregate("__edits", F.col("active"), switch), F.col("active")))
    j = j.withColumn("entity_type", F.coalesce(F.try_element_at(kinds, F.lit(-1)).kind, F.col("entity_type")))
    return j.where(~F.coalesce(F.exists("__edits", lambda e: e.action == "remove"), F.lit(False))).drop("__edits")


def add_manual(findings: DataFrame, added: DataFrame) -> DataFrame:
    """Findings with those marked by hand (doc_id, start, end, entity_type, text). One over exactly the range of a finding
    there is makes that one active instead."""
    a = added.where("start < end").dropDuplicates(["doc_id", "start", "end"])
    hit = a.select("doc_id", "start", "end", F.lit(True).alias("__again"))
    kept = findings.join(hit, ["doc_id", "start", "end"], "left").withColumn("active", F.col("active") | F.coalesce("__again", F.lit(False))).drop("__again")
    new = a.join(findings.select("doc_id", "start", "end"), ["doc_id", "start", "end"], "left_anti")
    new = new.withColumn("source", F.lit("manual")).withColumn("active", F.lit(True)).withColumn("score", F.lit(1.0)).withColumn("recognizer", F.lit("manual"))
    return kept.unionByName(new, allowMissingColumns=True)


def reanalysed(before: DataFrame, now: DataFrame) -> DataFrame:
    """Findings of a new analysis with the decisions taken before: an automatic finding over the same range keeps its
    state, and what came from elsewhere (by hand, from a review) stays."""
    keys = ["doc_id", "start", "end"]
    state = before.where("source = 'auto'").groupBy(*keys).agg(F.bool_and("active").alias("__was"))
    own = now.where("source = 'auto'").join(state, keys, "left").withColumn("active", F.coalesce("__was", "active")).drop("__was")
    return own.unionByName(before.where("source <> 'auto'"), allowMissingColumns=True)


def deny_everywhere(findings: DataFrame, terms: DataFrame) -> DataFrame:
    """Findings of the terms (term), any case, made inactive: what a review put on the allow list."""
    known = terms.select(casefold(F.trim("term")).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    out = findings.withColumn("__k", casefold(F.trim("text"))).join(known, "__k", "left")
    return out.withColumn("active", F.col("active") & F.col("__hit").isNull()).drop("__k", "__hit")


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n"))


def next_open(state: DataFrame, current: str) -> DataFrame:
    """The path of the first open entry after ``current`` in the order of folded paths; after the last one it starts anew."""
    here = casefold(F.lit(current))
    open_ = state.where(F.col("status").isin(TO_REVIEW, WAITING)).select("rel", casefold("rel").alias("k"))
    return open_.orderBy((F.col("k") <= here), "k", "rel").limit(1).select("rel")


#: Version of the stored state; another one is not read.
VERSION = 1


def save(state: DataFrame, target: str) -> None:
    """The state (rel, status, size, mtime_ns, sha256, text_sha, findings as ``compact``, note) as a snapshot of its own
    below ``target``; earlier ones stay, so a run that is cut off loses nothing."""
    state.withColumn("version", F.lit(VERSION)).write.mode("errorifexists").parquet(f"{target}/snapshot-{next_number(state.sparkSession, target):09d}")


def numbered(spark: SparkSession, target: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix`` and figures below ``target``, whole or not."""
    fs, path = _fs(spark, target)
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def next_number(spark: SparkSession, target: str) -> int:
    """Number of the next snapshot: above all there are, whole or cut off."""
    return max(numbered(spark, target, "snapshot-"), default=-1) + 1


def last_whole(spark: SparkSession, target: str) -> int | None:
    """Number of the last complete snapshot."""
    fs, _ = _fs(spark, target)
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/snapshot-{n:09d}/_SUCCESS"))
    return next((n for n in reversed(numbered(spark, target, "snapshot-")) if whole(n)), None)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it is there."""
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def load(spark: SparkSession, target: str) -> DataFrame | None:
    """The last complete snapshot, None if there is none. One of another version is refused."""
    last = last_whole(spark, target)
    if last is None:
        return None
    out = spark.read.parquet(f"{target}/snapshot-{last:09d}")
    if not out.where(F.col("version") != VERSION).isEmpty():
        raise ValueError(f"{target}: the state is of another version")
    return out.drop("version")


def _fs(spark: SparkSession, target: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
