"""Spans of text as columns: half-open ranges of code points, found and tested without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE = "\ue000", "\ue001"
SPAN = "array<struct<start:int,end:int,text:string>>"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row, however often later expressions name them. A projection would be
    merged into the ones after it, with a copy for each mention; the generator of one row is a border that stays in the JVM."""
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once a row, however often ``body`` names it: ``once`` inside of an expression. Where
    functions of columns are put into each other, a value named a few times in each stands in the plan as often as the product."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clear_of_marks(text: Column) -> Column:
    """A text without the signs that matches are marked by. Most have none, so the search for them saves the rewriting."""
    return F.when(F.contains(text, F.lit(OPEN)) | F.contains(text, F.lit(CLOSE)), F.translate(text, OPEN + CLOSE, "??")).otherwise(text)


def marked(text: Column | str, pattern: Column | str, group: bool = False, needs: Column | None = None) -> Column:
    """A text cut before each match of a Java pattern, the end of the match marked; null text: one empty piece.

    ``group``: the pattern is ``(before)(span)`` and only the second group is the span; ``before`` is passed over. ``needs``: a
    condition without which there is no match; the text is then not searched.
    """
    clean = clear_of_marks(F.coalesce(col(text), F.lit("")))
    mark = f"$1{OPEN}$2{CLOSE}" if group else f"{OPEN}$0{CLOSE}"
    cut = F.split(F.regexp_replace(clean, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(mark)), OPEN, -1)
    return cut if needs is None else F.when(needs, cut).otherwise(F.array(F.lit("")))


def not_after(chars: str) -> str:
    """Java pattern: the character before is none of a class. Java steps back by code points only where the class has a character
    beyond U+FFFF in it; else it sees half of one. The one put in is both parts of a class that is empty: it adds nothing."""
    beyond = "\U00010400"
    return f"(?<![{chars}[{beyond}&&[^{beyond}]]])"


#: Matches that are folded into spans at once: a fold copies its state at each step, so the matches of a text are folded in
#: stretches, and then the stretches.
STRETCH = 128


def spans_of(parts: Column) -> Column:
    """The matches in a text from ``marked``. ``parts`` is evaluated once."""

    def step(state, part):
        size = F.instr(part, CLOSE) - 1
        span = F.struct(state.at.alias("start"), (state.at + size).alias("end"), F.substring(part, F.lit(1), size).alias("text"))
        return F.struct((state.at + F.length(part) - 1).alias("at"), F.concat(state.found, F.array(span)).alias("found"))

    def append(state, part):
        placed = F.transform(part.found, lambda f: F.struct((f.start + state.at).alias("start"), (f.end + state.at).alias("end"), f.text.alias("text")))
        return F.struct((state.at + part.at).alias("at"), F.concat(state.found, F.array(placed)).alias("found"))

    def folded(own):
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
        stretches = F.transform(F.sequence(F.lit(2), F.size(own), F.lit(STRETCH)), lambda i: F.aggregate(F.slice(own, i, F.lit(STRETCH)), start, step))
        first = F.struct(F.length(F.try_element_at(own, F.lit(1))).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
        return F.aggregate(stretches, first, append, lambda s: F.flatten(s.found))

    # a text without a match skips the folds
    return F.flatten(F.transform(F.array(parts), lambda own: F.when(F.size(own) > 1, folded(own)).otherwise(F.array().cast(SPAN))))


def quoted(text: str) -> str:
    """A string as a literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans_sql(parts: str) -> str:
    """``spans_of`` as SQL text: plans with very many of them are built faster from text than call by call."""
    size = f"(instr(p, '{CLOSE}') - 1)"
    step = f"named_struct('at', s.at + length(p) - 1, 'found', concat(s.found, array(named_struct('start', s.at, 'end', s.at + {size}, 'text', substring(p, 1, {size})))))"
    stretches = f"transform(sequence(2, size({parts}), {STRETCH}), i -> aggregate(slice({parts}, i, {STRETCH}), named_struct('at', 0, 'found', cast(array() AS {SPAN})), (s, p) -> {step}))"
    append = "named_struct('at', s.at + p.at, 'found', concat(s.found, array(transform(p.found, f -> named_struct('start', f.start + s.at, 'end', f.`end` + s.at, 'text', f.text)))))"
    fold = f"aggregate({stretches}, named_struct('at', length(try_element_at({parts}, 1)), 'found', cast(array() AS array<{SPAN}>)), (s, p) -> {append}, s -> flatten(s.found))"
    return f"CASE WHEN size({parts}) > 1 THEN {fold} ELSE cast(array() AS {SPAN}) END"


def find_spans(text: Column | str, pattern: Column | str, group: bool = False) -> Column:
    """All matches of a Java pattern as array<struct<start, end, text>>; null text: empty array."""
    return spans_of(marked(text, pattern, group))


def char_at(text: Column | str, pos: Column) -> Column:
    """Character at a position counted from 0, empty beyond the ends."""
    return F.when(pos < 0, F.lit("")).otherwise(F.substring(col(text), pos + 1, F.lit(1)))


def guarded(spans: Column, text: Column | str, before: str | None = None, after: str | None = None) -> Column:
    """Spans whose neighbours do not match the classes: what look-around would ask, in a form that any engine has."""
    out = spans
    if before:
        out = F.filter(out, lambda s: ~char_at(text, s.start - 1).rlike(before))
    if after:
        out = F.filter(out, lambda s: ~char_at(text, s.end).rlike(after))
    return out


def running_max(items: Column) -> Column:
    """For each item of an array of int the largest one up to it, in stretches."""
    kind = "array<int>"
    step = lambda a, x: F.concat(a, F.array(F.greatest(F.try_element_at(a, F.lit(-1)), x)))
    own = lambda s: F.aggregate(s, F.array().cast(kind), step)

    def append(state, part):
        top = F.try_element_at(F.try_element_at(state, F.lit(-1)), F.lit(-1))
        return F.concat(state, F.array(F.transform(part, lambda x: F.greatest(x, top))))

    def folded(all_items):
        stretches = F.transform(F.sequence(F.lit(1), F.size(all_items), F.lit(STRETCH)), lambda i: own(F.slice(all_items, i, F.lit(STRETCH))))
        return F.flatten(F.aggregate(stretches, F.array().cast(f"array<{kind}>"), append))

    return let(items, lambda x: F.when(F.size(x) > 0, folded(x)).otherwise(F.array().cast(kind)))


def overlaps(a_start, a_end, b_start, b_end) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def count_at_or_before(items: Column, pos: Column, key: str | None = None) -> Column:
    """How many items of a sorted array (by ``key``, or of the items themselves) are at or before ``pos``, by halving: as many
    steps as the array's size has binary digits. The array is evaluated once, however costly it is."""
    first = F.struct(items.alias("own"), F.lit(0).alias("low"), F.size(items).alias("high"))

    def step(s, _):
        mid = ((s["low"] + s["high"] + 1) / 2).cast("int")
        item = F.try_element_at(s["own"], F.greatest(mid, F.lit(1)))
        inside = (item[key] if key else item) <= pos
        low = F.when((s["low"] < s["high"]) & inside, mid).otherwise(s["low"])
        high = F.when((s["low"] < s["high"]) & ~inside, mid - 1).otherwise(s["high"])
        return F.struct(s["own"].alias("own"), low.alias("low"), high.alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(items)))), first, step, lambda s: s["low"])


def last_at_or_before(items: Column, key: str, pos: Column) -> Column:
    """Last struct of an array sorted by ``key`` whose key is at or before ``pos`` (as-of lookup); null if there is none."""
    n = count_at_or_before(items, pos, key)
    return F.when(n > 0, F.try_element_at(items, F.nullif(n, F.lit(0))))


def map_back(pos: Column, removals: Column) -> Column:
    """Position in the original of a position in a text from which pieces were removed; ``removals``: array of
    (at, shift), the position in the shortened text and the characters removed up to there."""
    return pos + F.coalesce(last_at_or_before(removals, "at", pos)["shift"], F.lit(0))


def map_back_end(end: Column, removals: Column) -> Column:
    return F.when(end > 0, map_back(end - 1, removals) + 1).otherwise(map_back(end, removals))


def page_of(pos: Column, page_starts: Column) -> Column:
    """Number, from 0, of the last page that starts at or before ``pos``."""
    return F.greatest(count_at_or_before(page_starts, pos) - 1, F.lit(0))


def line_of(text: Column | str, pos: Column) -> Column:
    """Number of the line, from 1, that holds a position."""
    head = F.substring(col(text), F.lit(1), pos)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
