"""Redacted texts, the segments they are made of, and positions carried between original and redacted text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeveil.functions.spans import col, last_at_or_before, once
from lakeveil.functions.text import value_key
from lakeveil.operators.catalog import AREAS, token

MODES = ("placeholder", "numbered", "blackout")


#: A finding as redaction sees it.
_PLACE = "struct<start:int,end:int,entity_type:string,text:string>"


def active_groups(findings: Column | str) -> Column:
    """What is redacted: active findings that are no drawn areas, overlapping ones as one over their union. The first of a
    group leads: its kind and its text name the group. Touching findings stay two; empty ranges are passed over."""
    own = F.filter(col(findings), lambda f: f.active & ~f.entity_type.isin(*AREAS) & (f.start < f.end))
    order = F.array_sort(F.transform(own, lambda f: F.struct(f.start.alias("start"), (-f.end).alias("o"), f.entity_type.alias("entity_type"), f.text.alias("text"))))
    places = F.transform(order, lambda f: F.struct(f.start.alias("start"), (-f.o).alias("end"), f.entity_type.alias("entity_type"), f.text.alias("text")))

    def step(groups, x):
        last = F.try_element_at(groups, F.lit(-1))
        wider = last.withField("end", F.greatest(last.end, x.end))
        return F.when((F.size(groups) > 0) & (x.start < last.end), F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(wider))).otherwise(F.concat(groups, F.array(x)))

    return F.coalesce(F.aggregate(places, F.array().cast(f"array<{_PLACE}>"), step), F.array().cast(f"array<{_PLACE}>"))


def segments(text: Column | str, groups: Column | str, mode: str = "placeholder") -> Column:
    """array<struct<start, end, red_start, red_end, replacement, entity_type>> of ``active_groups`` in order. Numbers count
    the different values of a token by first appearance. A blackout keeps length and line feeds."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    t = F.coalesce(col(text), F.lit(""))
    keyed = F.transform(col(groups), lambda f: F.struct(f.start.alias("start"), f.end.alias("end"), f.entity_type.alias("entity_type"), token(f.entity_type).alias("token"), value_key(f.text).alias("key")))

    def replaced(f):
        if mode == "blackout":
            return F.regexp_replace(F.substring(t, f.start + 1, f.end - f.start), r"[^\n]", "█")
        if mode == "placeholder":
            return F.concat(F.lit("["), f.token, F.lit("]"))
        values = F.array_distinct(F.transform(F.filter(keyed, lambda k: k.token == f.token), lambda k: k.key))
        return F.concat(F.lit("["), f.token, F.lit("_"), F.array_position(values, f.key).cast("string"), F.lit("]"))

    made = F.transform(keyed, lambda f: F.struct(f.start.alias("start"), f.end.alias("end"), replaced(f).alias("replacement"), f.entity_type.alias("entity_type")))
    kind = "array<struct<start:int,end:int,red_start:int,red_end:int,replacement:string,entity_type:string>>"

    def step(state, s):
        at = s.start + state.shift
        size = F.length(s.replacement)
        row = F.struct(s.start.alias("start"), s.end.alias("end"), at.alias("red_start"), (at + size).alias("red_end"), s.replacement.alias("replacement"), s.entity_type.alias("entity_type"))
        return F.struct((state.shift + size - (s.end - s.start)).alias("shift"), F.concat(state.rows, F.array(row)).alias("rows"))

    return F.aggregate(made, F.struct(F.lit(0).alias("shift"), F.array().cast(kind).alias("rows")), step, lambda s: s.rows)


def apply_segments(text: Column | str, segs: Column) -> Column:
    """The redacted text: what stands between the segments, with their replacements."""
    t = F.coalesce(col(text), F.lit(""))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(segs, F.greatest(i, F.lit(1))).end)
    pieces = F.transform(segs, lambda s, i: F.concat(F.substring(t, before(i) + 1, s.start - before(i)), s.replacement))
    end = F.coalesce(F.try_element_at(segs, F.lit(-1)).end, F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(t, end + 1, F.length(t)))


def redact(detected: DataFrame, mode: str = "placeholder", text_col: str = "text", column: str = "findings") -> DataFrame:
    """``detected`` with the columns ``segments`` and ``redacted_text``. Inactive findings and drawn areas do nothing to the
    text, overlapping findings give one replacement; a text without findings stays as it is."""
    out = once(detected, __groups=active_groups(column))
    out = once(out, segments=segments(text_col, "__groups", mode)).drop("__groups")
    return out.withColumn("redacted_text", apply_segments(text_col, F.col("segments")))


def to_redacted(pos: Column, segs: Column) -> Column:
    """Position in the redacted text of one in the original; inside a segment: where that starts."""
    s = last_at_or_before(segs, "start", pos)
    return F.when(s.isNull(), pos).when(pos < s.end, s.red_start).otherwise(pos - s.end + s.red_end)


def to_original(pos: Column, segs: Column, end: bool = False) -> Column:
    """Position in the original of one in the redacted text; inside a segment: its start, or its end for ends."""
    s = last_at_or_before(segs, "red_start", pos)
    inside = (pos < s.red_end) & ((pos > s.red_start) if end else F.lit(True))
    return F.when(s.isNull(), pos).when(inside, s.end if end else s.start).when(F.lit(end) & (pos == s.red_start), s.start).otherwise(pos - s.red_end + s.end)
