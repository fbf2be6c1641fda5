"""What redaction may have missed: further occurrences of values found, leftovers in the output, files held back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakeveil.functions.spans import char_at, count_at_or_before, find_spans, last_at_or_before, let, once, running_max
from lakeveil.functions.text import quote_pattern, squashed_key, surname, value_key, word_pattern
from lakeveil.operators.catalog import AREAS


#: Articles and prepositions: a surname after one of them is a common noun or a place.
NO_SURNAME_AFTER = "der die das den dem des ein eine einen einem einer am im in zum zur vom beim auf aus bei mit nach über unter vor the a an of".split()


def surname_hit(text, start, end, word):
    """Whether a surname found again is the person: with a capital, unless an article or preposition stands before; in
    lower case, only where it is a part of a file name or an address (a joiner or a digit beside it)."""
    head = F.lower(F.regexp_extract(F.substring(text, F.greatest(start - 19, F.lit(1)), F.least(start, F.lit(20))), r"(\p{L}+)\s+$", 1))
    joined = char_at(text, start - 1).rlike(r"[-_./\\@0-9]") | char_at(text, end).rlike("[0-9]") | (char_at(text, end).rlike(r"[-_./\\@]") & char_at(text, end + 1).rlike(r"[\p{L}\p{N}]"))
    return F.when(word.rlike(r"^\p{Lu}"), ~head.isin(*NO_SURNAME_AFTER)).otherwise(joined)


#: A place where a value stands again; ``rank`` is its value's turn.
_PLACE = "array<struct<start:int,end:int,rank:int,text:string,entity_type:string>>"


def _values(own: Column) -> Column:
    """Values to look for, in their order: whole ones before surnames of persons, then by first appearance, each key once."""

    def value(phase, f, i, text):
        own = (F.lit(phase).alias("phase"), f.start.alias("at"), i.alias("i"))
        return let(text, lambda t: F.struct(squashed_key(t).alias("k"), *own, word_pattern(t).alias("re"), f.entity_type.alias("entity_type")))

    whole = F.transform(own, lambda f, i: value(1, f, i, f.text))
    names = F.transform(own, lambda f, i: F.when(f.entity_type == "PERSON", value(2, f, i, surname(f.text))))
    by_key = F.array_sort(F.filter(F.concat(whole, names), lambda x: x.re.isNotNull()))
    first = let(by_key, lambda a: F.filter(a, lambda x, i: (i == 0) | (x.k != F.try_element_at(a, F.greatest(i, F.lit(1))).k)))
    return F.array_sort(F.transform(first, lambda x: F.struct(x.phase.alias("phase"), x["at"].alias("at"), x.i.alias("i"), x.re.alias("re"), x.entity_type.alias("entity_type"))))


def _claimed(places: Column) -> Column:
    """Places that overlap each other, given out by rank: one that overlaps an earlier one is left out. What is taken stays
    sorted, so the one place that can be in the way is looked up by halving."""

    def step(a, x):
        n = count_at_or_before(a, x.end - 1, "start")
        free = lambda n: F.when((n > 0) & (F.try_element_at(a, F.greatest(n, F.lit(1))).end > x.start), a).otherwise(F.concat(F.slice(a, F.lit(1), n), F.array(x), F.slice(a, n + 1, F.size(a))))
        return let(n, free)

    by_rank = F.array_sort(F.transform(places, lambda p: F.struct(p.rank.alias("rank"), p.start.alias("start"), p.end.alias("end"), p.text.alias("text"), p.entity_type.alias("entity_type"))))
    in_turn = F.transform(by_rank, lambda p: F.struct(p.start.alias("start"), p.end.alias("end"), p.rank.alias("rank"), p.text.alias("text"), p.entity_type.alias("entity_type")))
    return F.aggregate(in_turn, F.array().cast(_PLACE), step)


def with_further(detected: DataFrame, text_col: str = "text", column: str = "findings", into: str = "further") -> DataFrame:
    """A column of places (start, end, rank, text, entity_type) where an active value stands again, outside of all findings,
    active or not. Whole values go before surnames of persons, values in order of appearance; a place is given once. Made on
    the row: no text is shuffled. Places are sorted and parted where none reaches over, so the work grows with them times their
    logarithm, but for the lists of such places as overlap in a chain."""
    none = F.array().cast(_PLACE)
    own = F.filter(column, lambda f: f.active)
    out = once(detected, __live=F.when(F.size(own) > 0, own))
    out = once(out, __values=F.when(F.col("__live").isNotNull(), _values(F.col("__live")))).drop("__live")
    out = once(out, __own=F.when(F.size("__values") > 0, F.array_sort(F.transform(column, lambda f: F.struct(f.start.alias("start"), f.end.alias("end"))))))
    out = once(out, __reach=F.when(F.col("__own").isNotNull(), running_max(F.transform("__own", lambda f: f.end))))

    def free(s):
        before = count_at_or_before(F.col("__own"), s.end - 1, "start")
        return let(before, lambda n: (n == 0) | (F.try_element_at("__reach", F.greatest(n, F.lit(1))) <= s.start))

    def places(x, i):
        hits = F.filter(find_spans(text_col, x.re), free)
        named = F.when(x.phase == 1, hits).otherwise(F.filter(hits, lambda s: surname_hit(F.col(text_col), s.start, s.end, s.text)))
        return F.transform(named, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), i.alias("rank"), s.text.alias("text"), x.entity_type.alias("entity_type")))

    found = F.array_sort(F.flatten(F.transform("__values", places)))
    out = once(out, __found=F.when(F.col("__own").isNotNull(), found)).drop("__values", "__own", "__reach")
    out = once(out, __to=F.when(F.size("__found") > 0, running_max(F.transform("__found", lambda p: p.end))))
    at = lambda name, i: F.try_element_at(F.col(name), F.greatest(i, F.lit(1)))
    begins = F.filter(F.sequence(F.lit(1), F.size("__found")), lambda i: (i == 1) | (at("__found", i).start >= at("__to", i - 1)))
    out = once(out, __begins=F.when(F.col("__to").isNotNull(), begins)).drop("__to")

    def part(b, i):
        stop = F.coalesce(F.try_element_at("__begins", i + 2), F.size("__found") + 1)
        return let(F.slice("__found", b, stop - b), lambda p: F.when(F.size(p) > 1, _claimed(p)).otherwise(p))

    return once(out, **{into: F.coalesce(F.flatten(F.transform("__begins", part)), none)}).drop("__found", "__begins")


def further_occurrences(detected: DataFrame, key: str = "doc_id", text_col: str = "text", column: str = "findings") -> DataFrame:
    """(key, start, end, entity_type, text, source, active): the places of ``with_further``, a row each."""
    out = with_further(detected.select(key, text_col, column), text_col, column, "__further").select(key, F.explode("__further").alias("c"))
    return out.select(key, "c.start", "c.end", "c.entity_type", "c.text", F.lit("control").alias("source"), F.lit(False).alias("active"))


def leftovers(redacted: DataFrame, key: str = "doc_id", column: str = "findings") -> DataFrame:
    """(key, value, n): active values that stand in the redacted text more often than they were left there on purpose, by
    deselected findings of the same value; n counts those beyond. What stands in a replacement is none: the value ``Name``
    is not left over in ``[NAME]``."""
    own = redacted.where(F.size(column) > 0).select(key, "redacted_text", "segments", F.explode(column).alias("f")).where(~F.col("f.entity_type").isin(*AREAS))
    own = own.select(key, "redacted_text", "segments", value_key("f.text").alias("value"), word_pattern("f.text").alias("re"), F.col("f.active").alias("active"))
    held = own.groupBy(key, "value").agg(F.count_if(~F.col("active")).alias("left"), F.count_if("active").alias("gone"), F.first(F.struct("redacted_text", "segments")).alias("own"), F.min("re").alias("re")).where("gone > 0 and re is not null")
    held = once(held, __hits=find_spans("own.redacted_text", F.col("re")))
    # hits and replacements in order: the last replacement that begins before a hit's end reaches into it, or none does
    made = lambda h: F.coalesce(last_at_or_before(F.col("own.segments"), "red_start", h.end - 1).red_end > h.start, F.lit(False))
    n = F.size(F.filter("__hits", lambda h: ~made(h))) - F.col("left")
    return held.select(key, "value", n.cast("int").alias("n")).where("n > 0")


def hold_back(detected: DataFrame, further: DataFrame | None = None, key: str = "doc_id", column: str = "findings", text_col: str = "text") -> DataFrame:
    """(key, status, n_findings, n_further): to_review where values stand again outside of findings, else auto. Places are
    counted on the row; a table of them (``further``) is joined by key."""
    if further is None:
        out = with_further(detected.select(key, text_col, column), text_col, column, "__further").select(key, F.size(column).alias("n_findings"), F.size("__further").cast("long").alias("n_further"))
    else:
        n = further.groupBy(key).agg(F.count("*").alias("n_further"))
        out = detected.select(key, F.size(column).alias("n_findings")).join(n, key, "left").withColumn("n_further", F.coalesce("n_further", F.lit(0)).cast("long"))
    return out.select(key, F.when(F.col("n_further") > 0, "to_review").otherwise("auto").alias("status"), "n_findings", "n_further")


def worst(codes: DataFrame) -> DataFrame:
    """Exit code of a run: leftovers (2), error (1), held back (3), fast mode (4), fine (0), in this order."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ((2, 4), (1, 3), (3, 2), (4, 1), (0, 0)) for x in kv]), F.col("code"))
    return codes.agg(F.coalesce(F.max_by("code", rank), F.lit(0)).alias("code"))


def locate_quotes(hints: DataFrame, key: str = "doc_id", most: int = 20) -> DataFrame:
    """Places of quotes (key, text, quote) in a text, white space aside: one row per place, ``most`` a quote."""
    pattern = quote_pattern("quote")
    spans = F.when(pattern.isNotNull(), find_spans("text", pattern))
    return hints.select(key, "quote", F.explode(F.slice(spans, 1, most)).alias("s")).select(key, "quote", "s.start", "s.end")
