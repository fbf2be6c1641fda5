"""Marked texts to measure detection by, and settings from JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakeveil.functions.spans import find_spans, once
from lakeveil.operators.detect import Settings


def gold_spans(marked: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, start, end, entity_type) from marks (doc_id, context, entity_type): a piece of the text with the value between
    guillemets, found where it stands first. A context that is not in the text gives no row."""
    j = marked.join(texts.select("doc_id", "text"), "doc_id").withColumn("plain", F.translate("context", "«»", ""))
    at = F.instr("text", F.col("plain"))
    j = j.where((at > 0) & (F.instr("context", "«") > 0) & (F.instr("context", "»") > F.instr("context", "«")))
    start = at - 1 + F.instr("context", "«") - 1
    size = F.instr("context", "»") - F.instr("context", "«") - 1
    return j.select("doc_id", start.cast("int").alias("start"), (start + size).cast("int").alias("end"), "entity_type")


CASE = "struct<name:string,text:string,redact:array<struct<text:string,type:string>>,expected:array<string>,harmless:array<string>>"


def _listed(name: str):
    return lambda x: F.struct(F.lit(name).alias("list"), x.alias("t"), F.lit(None).cast("string").alias("entity_type"))


def review_cases(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """From one JSON case a row: (name, text) and (name, list, start, end, entity_type), every place where a text of the
    lists redact, expected and harmless stands. Rows that are no case are passed over."""
    own = once(lines.select(F.from_json(column, CASE).alias("c")), name=F.col("c.name"), text=F.col("c.text")).where("name is not null and text is not null")
    none = F.array().cast("array<struct<list:string,t:string,entity_type:string>>")
    wanted = F.concat(
        F.coalesce(F.transform("c.redact", lambda x: F.struct(F.lit("redact").alias("list"), x.text.alias("t"), x.type.alias("entity_type"))), none),
        *[F.coalesce(F.transform(f"c.{k}", _listed(k)), none) for k in ("expected", "harmless")],
    )
    each = own.select("name", "text", F.explode(wanted).alias("w")).where(F.length("w.t") > 0)
    quoted = F.concat(F.lit(r"\Q"), F.replace(F.col("w.t"), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    places = once(each, s=find_spans("text", quoted)).select("name", "w.list", F.explode("s").alias("s"), "w.entity_type")
    return own.select("name", "text"), places.select("name", "list", "s.start", "s.end", "entity_type")


def read_settings(defaults: str | None, user: str | None) -> Settings:
    """Settings of two JSON texts: the user's over the defaults, but for the keys that the defaults list under ``locked``. A text
    that is no JSON object counts as empty, values of a wrong type are passed over."""

    def loaded(text: str | None) -> dict:
        try:
            out = json.loads(text or "{}")
        except ValueError:
            return {}
        return out if isinstance(out, dict) else {}

    base = loaded(defaults)
    locked = base.get("locked", [])
    return Settings.combined(base, loaded(user), [k for k in locked if isinstance(k, str)] if isinstance(locked, list) else [])


def write_settings(settings: Settings) -> str:
    """What ``read_settings`` reads as a user's settings."""
    return json.dumps({k: v for k, v in vars(settings).items() if k != "names"}, ensure_ascii=False, sort_keys=True)


def needs_reanalysis(before: Settings, after: Settings) -> bool:
    """Whether findings depend on what changed: anything but the form of the replacement."""
    return any((set(a) != set(b)) if isinstance(a, list) else a != b for a, b in ((getattr(before, k), getattr(after, k)) for k in ("threshold", "entities", "allow", "deny", "names")))


def labelled_terms(spark: SparkSession, allow: list[str], deny: list[str]) -> DataFrame:
    return spark.createDataFrame([("allow", t) for t in allow] + [("deny", t) for t in deny], "list string, term string")
