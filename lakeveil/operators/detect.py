"""From texts to merged findings, row by row: no shuffle, so a corpus of any size is one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakeveil.functions.spans import char_at, clear_of_marks, col, map_back, map_back_end, marked, once, spans_of
from lakeveil.functions.text import EDGES, casefold, dehyphenate, hyphen_map, plain_spaces, title_case
from lakeveil.operators.catalog import DEFAULTS
from lakeveil.operators.recognizers import FOUND, find_terms, recognized


@dataclass
class Settings:
    threshold: float = 0.45
    entities: list[str] = field(default_factory=lambda: list(DEFAULTS))
    allow: list[str] = field(default_factory=list)
    deny: list[str] = field(default_factory=list)
    mode: str = "placeholder"
    #: names found by a model: text column -> FOUND with ``ner`` true
    names: Callable[[Column], Column] | None = None

    @staticmethod
    def combined(defaults: dict, user: dict, locked: list[str] = ()) -> Settings:
        """User over defaults, locked keys from the defaults, lists of terms added, values of a wrong type passed over."""
        base = Settings()
        for source, lock in ((defaults, False), (user, True)):
            for k, v in source.items():
                if k in ("allow", "deny") and isinstance(v, list):
                    setattr(base, k, getattr(base, k) + [x for x in v if isinstance(x, str) and x not in getattr(base, k)])
                elif hasattr(base, k) and not (lock and k in locked and k in defaults):
                    old = getattr(base, k)
                    if old is not None and (isinstance(v, type(old)) or isinstance(old, float) and type(v) is int):
                        setattr(base, k, v)
        return base


def _moved(found: Column, by: Column) -> Column:
    return F.transform(found, lambda s: s.withField("start", s.start + by).withField("end", s.end + by))


def _new(probe: Column, known: Column, text: Column) -> Column:
    """Hits that cover a character, other than white space, that no known finding covers."""
    bare = lambda s: F.exists(F.sequence(s.start, s.end - 1), lambda i: ~F.exists(known, lambda k: (k.start <= i) & (i < k.end)) & ~F.substring(text, i + 1, F.lit(1)).rlike(r"\s"))
    return F.filter(probe, bare)


def joints(text: Column, blanks: bool = True) -> Column:
    """Line ends, with the ``blanks`` around them, over which a number may go on: a letter or digit before, and after it a
    digit, a plus, or a single capital before a digit."""
    around, goes_on = r"\h*" if blanks else "", "(?:[0-9+]|[A-Z][0-9])"
    parts = marked(text, rf"(?<=[0-9A-Za-z]){around}\n{around}(?={goes_on})", needs=text.rlike(rf"\n{around}{goes_on}"))
    return spans_of(parts)


def _joined(text: Column, ends: Column) -> Column:
    """The text with a blank for each of the spans ``ends``; null if there are none."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1).end)
    pieces = F.transform(ends, lambda j, i: F.substring(text, begin(i) + 1, j.start - begin(i)))
    last = F.try_element_at(ends, F.lit(-1)).end
    return F.when(F.size(ends) > 0, F.concat(F.array_join(pieces, " "), F.lit(" "), F.substring(text, last + 1, F.length(text))))


def _shifts(ends: Column) -> Column:
    """For ``map_back``: what a text lost by ``_joined``."""
    start = F.struct(F.lit(0).alias("shift"), F.array().cast("array<struct<at:int,shift:int>>").alias("found"))

    def step(s, j):
        shift = s["shift"] + j.end - j.start - 1
        return F.struct(shift.alias("shift"), F.concat(s["found"], F.array(F.struct((j.start + 1 - s["shift"]).alias("at"), shift.alias("shift")))).alias("found"))

    return F.aggregate(ends, start, step, lambda s: s["found"])


def cross_line(df: DataFrame, text: str, known: str, settings: Settings, blanks: bool = True) -> DataFrame:
    """Adds to ``known`` the numbers that go on in the next line: hits in the text with such line ends as blanks that span
    one of them. A text without such a line end skips the pass. Without ``blanks`` a blank beside a line end ends the number."""
    t = F.col(text)
    out = once(df, __ends=joints(t, blanks))
    out = once(out, __flat=_joined(t, F.col("__ends")), __shift=_shifts(F.col("__ends")))
    out = recognized(out, "__flat", settings.entities, settings.threshold, into="__probe")
    moved = F.transform("__probe", lambda s: s.withField("start", map_back(s.start, F.col("__shift"))).withField("end", map_back_end(s.end, F.col("__shift"))))
    over = F.filter(moved, lambda s: F.exists("__ends", lambda j: (s.start < j.start) & (j.end < s.end)))
    return once(out, **{known: F.concat(known, _new(over, F.filter(known, lambda k: ~k.ner), t))}).drop("__ends", "__flat", "__shift", "__probe")


def upper_case(df: DataFrame, text: str, known: str, settings: Settings) -> DataFrame:
    """Adds names and addresses in capitals: hits of case-bound recognizers in the text in title case that take in such a
    word. A text without a word in capitals skips the pass."""
    t = F.col(text)
    out = once(df, __words=spans_of(marked(t, r"(?<!\p{L})\p{Lu}{3,}(?:-\p{Lu}+)*(?!\p{L})", needs=t.rlike(r"\p{Lu}{3}"))))
    out = once(out, __title=F.when(F.size("__words") > 0, title_case(t)))
    out = recognized(out, "__title", settings.entities, settings.threshold, lambda r: r.case_bound, into="__probe")
    if settings.names is not None:
        out = once(out, __probe=F.concat("__probe", F.filter(clean_names(settings.names(F.col("__title"))), lambda s: ~s.text.rlike("[0-9]"))))
    hits = F.filter("__probe", lambda s: F.exists("__words", lambda w: (w.start < s.end) & (s.start < w.end)) & (F.instr(F.substring(t, s.start + 1, s.end - s.start), "\n") == 0))
    return once(out, **{known: F.concat(known, _new(hits, F.col(known), t))}).drop("__words", "__title", "__probe")


#: Words that a model takes for names and that are none.
NO_NAMES = ["ich", "sie", "er", "wir", "ihr", "es", "der", "die", "das", "den", "dem", "ein", "eine", "herr", "frau", "herrn", "dr", "prof", "tel", "telefon", "fax", "mail", "iban", "datum", "betreff", "anlage", "seite", "vertrag", "kunde", "firma"]


#: Names are letters, marks and figures, blanks, and what joins or shortens them; anything else parts two of them.
_NO_NAME = r"[^\p{L}\p{M}\p{Nd}\p{Zs} .,'’‘`´&+\p{Pd}]"


def clean_names(found: Column) -> Column:
    """Hits of a model, cut at characters that no name has; parts of two characters and more that start with a capital."""

    def parts(s):
        pieces = F.split(s.text, _NO_NAME, -1)
        at = lambda i: F.aggregate(F.slice(pieces, F.lit(1), i), F.lit(0), lambda a, p: a + F.length(p) + 1)
        whole = F.transform(pieces, lambda p, i: s.withField("start", s.start + at(i)).withField("end", s.start + at(i) + F.length(p)).withField("text", p))
        return F.filter(whole, lambda p: (F.length(F.trim(p.text)) >= 2) & F.trim(p.text).rlike(r"^\p{Lu}") & ~casefold(F.trim(p.text)).isin(NO_NAMES))

    return F.flatten(F.transform(found, lambda s: F.when(s.ner, parts(s)).otherwise(F.array(s))))


def trimmed(found: Column, text: Column) -> Column:
    """Findings without white space, brackets, quotation marks and separators at their ends; what is nothing else goes."""

    def cut(s):
        own = F.substring(text, s.start + 1, s.end - s.start)
        left = F.length(own) - F.length(F.regexp_replace(own, rf"^{EDGES}+", ""))
        right = F.length(own) - F.length(F.regexp_replace(own, rf"{EDGES}+$", ""))
        return s.withField("start", s.start + left).withField("end", s.end - right)

    return F.filter(F.transform(found, cut), lambda s: s.start < s.end)


def merged(found: Column) -> Column:
    """Overlapping findings as one over their union; touching ones stay two. Of each group the finding that is not a
    model's comes before one that is, then the higher score, then the longer one, then the first; recognizers are named
    together. ``found`` is named several times: give a column, not an expression."""
    order = F.array_sort(found, lambda a, b: F.when(a.start < b.start, -1).when(a.start > b.start, 1).when(a.end > b.end, -1).when(a.end < b.end, 1).otherwise(0))
    lists = F.transform(order, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.alias("best"), F.array(s.recognizer).alias("names")))
    better = lambda a, b: F.struct((~b.ner).alias("p"), b.score.alias("s"), (b.end - b.start).alias("l")) > F.struct((~a.ner).alias("p"), a.score.alias("s"), (a.end - a.start).alias("l"))

    def step(groups, x):
        last = F.try_element_at(groups, F.lit(-1))
        joined = F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"), F.when(better(last.best, x.best), x.best).otherwise(last.best).alias("best"), F.array_distinct(F.concat(last.names, x.names)).alias("names"))
        return F.when((F.size(groups) > 0) & (x.start < last.end), F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(x)))

    folded = F.aggregate(lists, F.slice(lists, F.lit(1), F.lit(0)), step)
    out = F.transform(folded, lambda g: g.best.withField("start", g.start).withField("end", g.end).withField("recognizer", F.array_join(F.array_sort(g.names), ", ")))
    return F.when(F.size(found) > 1, out).otherwise(found)


def allowed_out(found: Column, text: Column, allow: list[str]) -> Column:
    """Findings whose whole text is an allowed term go; after merging, so that a part of a finding does not count."""
    keys = [t.strip().lower().replace("ß", "ss") for t in allow if t and t.strip()]
    if not keys:
        return found
    return F.filter(found, lambda s: ~casefold(F.trim(F.substring(text, s.start + 1, s.end - s.start))).isin(keys))


def detect(docs: DataFrame, settings: Settings | None = None, text_col: str = "text", into: str = "findings") -> DataFrame:
    """``docs`` with the merged findings of each text in a new array column, positions and texts those of the original.

    Null and empty texts have no findings. Every step is an expression on the row, evaluated once; passes that find
    nothing to do (no line end inside a number, no word in capitals) are skipped. Columns named like the working columns
    (``__norm``, ``__map``, ``__f`` and those of the passes) are not allowed.
    """
    s = settings or Settings()
    kinds = [e for e in s.entities if e != "CUSTOM"]
    s2 = Settings(s.threshold, kinds, s.allow, s.deny, s.mode, s.names)
    original = F.coalesce(col(text_col), F.lit(""))
    out = once(docs, __plain=plain_spaces(clear_of_marks(original)))
    out = once(out, __norm=dehyphenate("__plain"), __map=hyphen_map("__plain"))
    norm = F.col("__norm")
    out = recognized(out, "__norm", kinds, s.threshold, into="__f")
    more = [find_terms(norm, s.deny)]
    if s.names is not None:
        more.append(clean_names(F.filter(s.names(norm), lambda f: f.entity_type.isin(*kinds))))
    if s.deny or s.names is not None:
        out = once(out, __f=F.concat("__f", *more))
    out = upper_case(cross_line(out, "__norm", "__f", s2), "__norm", "__f", s2)
    out = once(out, __f=trimmed(F.col("__f"), norm))
    out = once(out, __f=merged(F.col("__f")))
    kept = allowed_out(F.col("__f"), norm, s.allow)

    def back(x):
        start, end = map_back(x.start, F.col("__map")), map_back_end(x.end, F.col("__map"))
        return x.withField("start", start).withField("end", end).withField("text", F.substring(original, start + 1, end - start))

    return once(out, **{into: F.transform(kept, back)}).drop("__plain", "__norm", "__map", "__f")


def findings_table(detected: DataFrame, key: str = "doc_id", column: str = "findings") -> DataFrame:
    """One row per finding."""
    return detected.select(key, F.explode(column).alias("f")).select(key, *[f"f.{c}" for c in ("start", "end", "entity_type", "text", "score", "source", "active", "recognizer")])


def merge_overlaps(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """``merged`` over a table of findings (also hand-made ones): islands by a running maximum of ends, one shuffle."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"))
    seen = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("start") < seen, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    names = F.array_join(F.array_sort(F.collect_set("recognizer")), ", ")
    rank = F.struct(~F.col("ner"), F.col("score"), F.col("end") - F.col("start"), -F.col("start"))
    best = F.max_by(F.struct("entity_type", "score"), rank)
    return findings.withColumn("__g", isle).groupBy(key, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end"), best.alias("b"), names.alias("recognizer")).select(key, "start", "end", "b.entity_type", "b.score", "recognizer")


def bio_spans(tokens: DataFrame, doc_text: DataFrame | None = None) -> DataFrame:
    """Entities of token labels (doc_id, i, start, end, label, score): runs of one kind, a B- or S- opens a new one; score:
    the mean. Parts stand next to each other or one character apart; with ``doc_text`` (doc_id, text) that character must
    be a blank or a hyphen, without it any but one that the next label opens anew counts."""
    w = Window.partitionBy("doc_id").orderBy("i")
    t = tokens.where("label <> 'O'").withColumn("kind", F.regexp_replace("label", "^[BIES]-", "")).withColumn("gap", F.lit(" "))
    if doc_text is not None:
        t = t.join(doc_text.select("doc_id", F.col("text").alias("__t")), "doc_id").withColumn("gap", char_at("__t", F.col("start") - 1)).drop("__t")
    apart = F.col("start") - F.lag("end").over(w)
    new = F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind")) | F.col("label").rlike("^[BS]-") | (apart > 1) | ((apart == 1) & ~F.col("gap").isin(" ", "-")) | (F.col("i") - F.lag("i").over(w) > 1)
    return t.withColumn("g", F.sum(new.cast("int")).over(w)).groupBy("doc_id", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("kind").alias("entity_type"), F.bround(F.avg("score"), 3).alias("score")).drop("g")
