"""A second look at redacted texts by a reviewer (a language model or any function): what it is shown, what its answers
mean, where they point to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeveil.functions.spans import find_spans, once
from lakeveil.functions.text import casefold, json_answer, quote_pattern

#: Risks in order.
RISKS = ("none", "low", "medium", "high")
ANSWER = "struct<risk:string,hints:array<struct<quote:string,kind:string,reason:string>>>"
#: What a reviewer calls things, and the kinds of findings they become; anything else is an own term.
KINDS = {"name": "PERSON", "person": "PERSON", "place": "LOCATION", "location": "LOCATION", "organisation": "ORGANIZATION", "organization": "ORGANIZATION", "address": "DE_ADDRESS", "date": "DATE_TIME", "phone": "PHONE_NUMBER", "email": "EMAIL_ADDRESS", "context": "CONTEXT"}


def packed_pages(page_ends: Column, most: int) -> Column:
    """array<struct<start, end, first, last>> of parts that hold whole pages up to ``most`` characters; ``page_ends``: where
    each page ends, ascending. A page longer than that is a part by itself; cut it with ``layout.chunks``."""
    part = "struct<start:int,end:int,first:int,last:int>"
    pages = F.transform(page_ends, lambda e, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(page_ends, i - 1)).cast("int").alias("start"), e.cast("int").alias("end"), i.cast("int").alias("first"), i.cast("int").alias("last")))

    def step(parts, p):
        last = F.try_element_at(parts, F.lit(-1))
        fits = (F.size(parts) > 0) & (p.end - last.start <= most)
        return F.when(fits, F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last.withField("end", p.end).withField("last", p.last)))).otherwise(F.concat(parts, F.array(p)))

    return F.aggregate(pages, F.array().cast(f"array<{part}>"), step)


def reviewed(parts: DataFrame, reviewer: Callable[[Iterator[list[str]]], Iterator[list[str]]], text_col: str = "text") -> DataFrame:
    """``parts`` with the column ``answer``: what the reviewer says to each text. It is given lists of texts, in batches on
    the executors, and gives a list of answers for each, so that a model is loaded once a worker. Show it redacted texts
    with numbered placeholders only."""

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for answers in reviewer(b.fillna("").tolist() for b in batches):
            yield pd.Series(answers, dtype="object")

    return parts.withColumn("answer", ask(F.col(text_col)))


def hints(answers: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """From (key, answer): (key, risk) and (key, quote, entity_type, reason). The risk is the highest known one of all
    answers, "unknown" if there is none; a hint is given once, the first answer (by its text) wins."""
    read = once(answers.select(key, "answer"), a=F.from_json(json_answer("answer"), ANSWER))
    order = F.array_position(F.array(*map(F.lit, RISKS)), F.lower(F.trim("a.risk")))
    best = F.max(F.when(order > 0, order))
    risk = read.groupBy(key).agg(best.alias("r")).select(key, F.coalesce(F.get(F.array(*map(F.lit, RISKS)), (F.col("r") - 1).cast("int")), F.lit("unknown")).alias("risk"))
    h = read.select(key, "answer", F.posexplode("a.hints").alias("i", "h")).where(F.trim("h.quote") != "")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.lower(F.trim("h.kind"))), F.lit("CUSTOM"))
    w = Window.partitionBy(key, casefold(F.trim("h.quote"))).orderBy("answer", "i")
    first = h.withColumn("n", F.row_number().over(w)).where("n = 1")
    return risk, first.select(key, F.trim("h.quote").alias("quote"), kind.alias("entity_type"), F.col("h.reason").alias("reason"))


def located(quotes: DataFrame, texts: DataFrame, key: str = "doc_id", most: int = 20) -> DataFrame:
    """(key, quote, start, end, text) of the places of quotes (key, quote) in the redacted texts (key, redacted_text,
    segments), white space aside: what is a placeholder is cut out of a place, what is left must hold a letter or digit and
    two characters; the first ``most`` places of a quote count."""
    j = once(quotes.select(key, "quote").join(texts.select(key, "redacted_text", "segments"), key), re=quote_pattern("quote"))
    j = once(j.where("re is not null"), spans=find_spans("redacted_text", F.col("re")))
    j = j.select(key, "quote", "redacted_text", "segments", F.explode(F.slice("spans", 1, most)).alias("s"))
    # from one placeholder in the place to the next
    inside = F.filter("segments", lambda g: (g.red_start < F.col("s.end")) & (F.col("s.start") < g.red_end))
    j = once(j, cut=inside)
    starts = F.concat(F.array("s.start"), F.transform("cut", lambda g: F.greatest(g.red_end, F.col("s.start"))))
    ends = F.concat(F.transform("cut", lambda g: F.least(g.red_start, F.col("s.end"))), F.array("s.end"))
    j = j.select(key, "quote", "redacted_text", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("p"))
    own = F.substring("redacted_text", F.col("p.a") + 1, F.col("p.b") - F.col("p.a"))
    left = F.length(own) - F.length(F.ltrim(own))
    out = j.select(key, "quote", (F.col("p.a") + left).alias("start"), F.trim(own).alias("text")).where(F.length("text") >= 2).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    return out.select(key, "quote", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def suggestions(places: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Places that are no findings yet, each once."""
    return places.dropDuplicates([key, "start", "end"]).join(findings.select(key, "start", "end"), [key, "start", "end"], "left_anti")


def rated(found: DataFrame, expected: DataFrame, harmless: DataFrame, key: str = "name") -> DataFrame:
    """Hints (key, start, end) as harmless, expected or other, in this order of precedence, by overlap."""

    def meets(df: DataFrame, mark: str) -> DataFrame:
        r = df.select(F.col(key).alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e"))
        hit = found.join(r, (F.col(key) == F.col("__k")) & (F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end")), "left_semi")
        return hit.select(key, "start", "end", F.lit(True).alias(mark)).distinct()

    out = found.join(meets(harmless, "__h"), [key, "start", "end"], "left").join(meets(expected, "__x"), [key, "start", "end"], "left")
    return out.withColumn("rating", F.when(F.col("__h"), "harmless").when(F.col("__x"), "expected").otherwise("other")).drop("__h", "__x")
