"""Term lists of any size: a hashed index of word n-grams, joined with the n-grams of the texts and verified on them.

A term is found as ``find_terms`` finds it: literally, not inside a word, the longest of those that begin at a place, no
two over one another (``find_listed``), or at its first place wherever that is (``first_places``). Its key is the hash of
its first words (ANCHOR at most). Texts are dealt into groups; each distinct n-gram of a group meets the list once, and a
group gets back the terms whose keys it holds. So the join grows with the words in use, not with their occurrences.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

#: Words of a term that make its key.
ANCHOR = 5
#: Keys that are sent to all tasks at once; more are joined by a shuffle.
SENT = 500_000
#: Characters of the texts of a group, on average.
GROUP_CHARS = 1 << 22

#: Letters, figures and low lines of any script, or one other sign.
_TOKEN = re.compile(r"\w+|[^\s\w]")
SPANS = "array<struct<start:int,end:int,text:string,term:string>>"
_SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("term", pa.string())])


def _same(c: str) -> str:
    """A character without its case, always one character."""
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else "i" if c == "İ" else c


def _lower(c: str) -> str:
    """A character as SQL lowers it, always one character."""
    low = c.lower()
    return low if len(low) == 1 else "i" if c == "İ" else c


class _Folds(dict):
    def __init__(self, of: Callable[[str], str]):
        self.of = of

    def __missing__(self, c: int) -> str:
        self[c] = self.of(chr(c))
        return self[c]


_FOLDS, _LOWERS = _Folds(_same), _Folds(_lower)


def folded(text: str, any_case: bool) -> str:
    """The text by which terms are compared; positions stay."""
    return (text.lower() if text.isascii() else text.translate(_FOLDS)) if any_case else text


def lowered(text: str) -> str:
    """The text in lower case; positions stay."""
    return text.lower() if text.isascii() else text.translate(_LOWERS)


def _key(words: str | tuple[str, ...]) -> int:
    data = words.encode("utf-8", "surrogatepass") if isinstance(words, str) else "\x00".join(words).encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.adler32(data)


def _in_word(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def grams(words: list[str], n: int):
    """The n-grams of a text's words, in order: tuples, or the words."""
    return words if n == 1 else zip(*[words[k:] for k in range(n)])


def _gram(words: list[str]) -> str | tuple[str, ...]:
    return words[0] if len(words) == 1 else tuple(words)


def chosen(text: str, low: str, words: list[str], places: list[int], index: dict, widths: list[int]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms of ``index`` (n-gram to folded terms, the longest first) that stand in a text: whole words,
    from the left, the longest first, none over another."""
    hits = [(places[i], t) for n in widths for i, g in enumerate(grams(words, n)) if g in index for t in index[g]]
    if len(widths) > 1:
        hits.sort(key=lambda h: (h[0], -len(h[1]), h[1]))
    out, at = [], 0
    for start, term in hits:
        end = start + len(term)
        if start < at or not low.startswith(term, start):
            continue
        if _in_word(text, start - 1) or _in_word(text, end):
            continue
        out.append((start, end, term))
        at = end
    return out


def _free(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name in low:
        name = "_" + name
    return name


def _searched(docs: DataFrame, listed: DataFrame, text_col: str, into: str, fold: Callable[[str], str], finder: Callable, sent: int) -> DataFrame:
    """``docs`` with the spans that ``finder(rows of listed)``, made once a group, finds in each text.

    ``listed`` (key, width, skip, term, whole): the key of ``width`` words; with width 0 a term goes to every group. Rows are
    dealt into groups by all their columns, so copies of a text do not gather in one.
    """
    own = docs.drop(into)
    number = _free("group", [*docs.columns, into])
    sizes = {r.width: r.n for r in listed.groupBy("width").agg(F.count("*").alias("n")).collect()}  # ANCHOR + 1 rows at most
    widths = sorted(w for w in sizes if w)
    chars = own.agg(F.sum(F.length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    groups = chars // GROUP_CHARS + 1
    dealt = own.withColumn(number, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in own.columns]), F.lit(groups)))

    def texts_of(table: pa.Table) -> list[str | None]:
        return table.column(text_col).cast(pa.string()).to_pylist()

    def used(table: pa.Table) -> pa.Table:
        seen: dict[int, set] = {n: set() for n in widths}
        for text in set(texts_of(table)):
            words = _TOKEN.findall(fold(text or ""))
            for n in widths:
                seen[n].update(grams(words, n))
        keys = {_key(g) for own in seen.values() for g in own}
        at = table.column(number)[0].as_py()
        return pa.table({"number": pa.array([at] * len(keys), pa.int64()), "key": pa.array(list(keys), pa.int64())})

    def verify(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts = texts_of(table)
        find = finder(answers.to_pylist())
        often = {t for t, n in Counter(texts).items() if n > 1}
        known: dict = {}
        offsets, parts = [0], ([], [], [], [])
        for text in texts:
            found = known.get(text)
            if found is None:
                found = find(text) if text is not None else []
                if text in often:
                    known[text] = found
            for a, b, term in found:
                for column, x in zip(parts, (a, b, text[a:b], term)):
                    column.append(x)
            offsets.append(len(parts[0]))
        spans = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, _SPAN_TYPE)], fields=list(_SPAN_TYPE))
        out = table.drop_columns([number])
        return out.append_column(into, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans))

    keyed = listed.where("width > 0")
    hits = dealt.groupBy(number).applyInArrow(used, "number long, key long")
    answers = hits.join(F.broadcast(keyed) if sum(sizes.values()) <= sent else keyed, "key").select("number", *listed.columns[1:])
    if sizes.get(0):
        anywhere = docs.sparkSession.range(groups).select(F.col("id").alias("number")).crossJoin(listed.where("width = 0").drop("key"))
        answers = answers.unionByName(anywhere)
    schema = StructType([*own.schema.fields, *StructType.fromDDL(f"`{into}` {SPANS}").fields])
    return dealt.groupBy(number).cogroup(answers.groupBy("number")).applyInArrow(verify, schema)


def _listed(terms: DataFrame, term_col: str, row: Callable[[str], tuple | None]) -> DataFrame:
    """(key, width, skip, term, whole) of the distinct terms that ``row`` makes one for."""
    schema = pa.schema([("key", pa.int64()), ("width", pa.int32()), ("skip", pa.int32()), ("term", pa.string()), ("whole", pa.string())])

    def index(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() if (r := row(t)) is not None]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return terms.select(F.col(term_col).cast("string").alias("t")).where("t is not null").distinct().mapInArrow(index, "key long, width int, skip int, term string, whole string").distinct()


def find_listed(docs: DataFrame, terms: DataFrame, term_col: str = "term", text_col: str = "text", any_case: bool = True, into: str = "found", sent: int = SENT, fold: Callable[[str], str] | None = None) -> DataFrame:
    """``docs`` with an array of (start, end, text, term) in the column ``into``: all places of the listed terms.

    ``term`` is the term without its case where case does not matter; ``fold`` (such as ``lowered``) compares by another form of
    equal length. Null, empty and blank terms are none; null and empty
    texts have no place. A list of any size is taken whole: up to ``sent`` keys go to all tasks, more are joined by key. An
    empty list or table gives empty arrays or no rows. A column named ``into`` is replaced, others stay.
    """

    fold = fold or (lambda t: folded(t, any_case))

    def row(t: str):
        term = fold(t.strip())
        words = _TOKEN.findall(term)[:ANCHOR]
        return (_key(_gram(words)), len(words), 0, term, term) if words else None

    def finder(answers: list[dict]):
        index: dict = {}
        for term in sorted({a["term"] for a in answers}, key=lambda t: (-len(t), t)):
            index.setdefault(_gram(_TOKEN.findall(term)[:ANCHOR]), []).append(term)
        widths = sorted({a["width"] for a in answers})

        def find(text: str) -> list[tuple[int, int, str]]:
            low = fold(text)
            found = list(_TOKEN.finditer(low))
            return chosen(text, low, [m[0] for m in found], [m.start() for m in found], index, widths)

        return find

    return _searched(docs, _listed(terms, term_col, row), text_col, into, fold, finder, sent)


def first_places(docs: DataFrame, terms: DataFrame, term_col: str = "term", text_col: str = "text", into: str = "found", sent: int = SENT) -> DataFrame:
    """``docs`` with an array of (start, end, text, term) in the column ``into``: the first place of each listed term, in lower
    case and wherever it begins, also inside a word and over other terms.

    The words between a term's first and last one stand whole in every text that holds it: they make its key. Terms
    of one or two words and empty ones have none and go to every group, where one automaton finds them. Null terms are none,
    null texts have no place; terms that differ in case only are two. Lists of any size, ``sent`` and ``into`` as in ``find_listed``.
    """

    def inner(term: str) -> tuple[list[str], int]:
        found = list(_TOKEN.finditer(term))
        return [m[0] for m in found[1:-1][:ANCHOR]], found[1].start() if len(found) > 2 else 0

    def row(t: str):
        words, skip = inner(lowered(t))
        return (_key(_gram(words)) if words else 0, len(words), skip, lowered(t), t)

    def finder(answers: list[dict]):
        index: dict = {}
        wholes: dict[str, list[str]] = {}
        short = ahocorasick.Automaton()
        for a in answers:
            if a["term"] not in wholes:
                if a["width"]:
                    index.setdefault(_gram(inner(a["term"])[0]), []).append((a["skip"], a["term"]))
                elif a["term"]:
                    short.add_word(a["term"], a["term"])
            wholes.setdefault(a["term"], []).append(a["whole"])
        short.make_automaton()
        widths = sorted({a["width"] for a in answers if a["width"]})

        def find(text: str) -> list[tuple[int, int, str]]:
            low = lowered(text)
            first = {"": 0} if "" in wholes else {}
            if len(short):
                for end, term in short.iter(low):
                    first.setdefault(term, end + 1 - len(term))
            found = list(_TOKEN.finditer(low)) if widths else []
            for n in widths:
                for m, g in zip(found, grams([m[0] for m in found], n)):
                    for skip, term in index.get(g, ()):
                        if term not in first and m.start() >= skip and low.startswith(term, m.start() - skip):
                            first[term] = m.start() - skip
            return sorted((at, at + len(term), whole) for term, at in first.items() for whole in wholes[term])

        return find

    return _searched(docs, _listed(terms, term_col, row), text_col, into, lowered, finder, sent)
