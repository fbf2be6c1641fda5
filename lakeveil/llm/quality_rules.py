"""Quality rules by repetition coverage (operator 9).

Rolling hashes of several n-gram lengths, computed in numpy from one prefix sum per block of texts, give the characters
that lie inside duplicated n-grams and inside duplicated lines. One scan, no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Words, arrays, covered, later, mix, per_text, repeated, rolling, slices, text_buffer

#: Largest share of word characters inside n-grams that also stand earlier in the text, by n.
GRAM_SHARE = {5: 0.30, 6: 0.29, 7: 0.28, 8: 0.27, 9: 0.26, 10: 0.25}
#: Largest share of word characters inside lines that equal an earlier line.
LINE_SHARE = 0.30
MIN_WORDS = 50
#: Base rule: percent of the words in 3-word windows that are found twice or more.
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("dup_gram_share", pa.float64()), ("dup_line_share", pa.float64())]
)
DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_gram_share double, dup_line_share double"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_SALT = np.uint64(0xA24BAED4963EE407)


def measure(raw: np.ndarray, offsets: np.ndarray, gram_share: dict[int, float], line_share: float) -> tuple[np.ndarray, ...]:
    """Columns of SCHEMA behind doc_id for texts given as bytes and offsets."""
    w, n_docs = Words(raw, offsets), len(offsets) - 1
    n_words, points = np.diff(w.first), w.points()
    chars = per_text(points, w.first)
    seen = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum(_SYMBOL[raw], out=seen[1:])
    symbols = seen[offsets[1:]] - seen[offsets[:-1]]
    salt = mix(np.arange(n_docs, dtype=np.uint64) + _SALT)

    def keyed(n: int) -> tuple[np.ndarray, np.ndarray]:
        at, h = w.grams(n)
        return at, h ^ salt[w.doc[at]]

    at, key = keyed(3)
    repeat = per_text(covered(at[repeated(key)], 3, len(w)), w.first)

    total = np.maximum(chars, 1)
    shares = []
    for n in gram_share:
        at, key = keyed(n)
        shares.append(per_text(covered(at[later(key)], n, len(w)) * points, w.first) / total)

    # lines: a text of n line feeds has n + 1 lines
    feeds = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
    starts = starts[starts < len(raw)]
    ends = np.minimum(np.append(feeds, len(raw))[np.searchsorted(feeds, starts)], offsets[np.searchsorted(offsets, starts, side="right")])
    lo, hi = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
    full = hi > lo
    starts, ends, lo, hi = starts[full], ends[full], lo[full], hi[full]
    doc = w.doc[lo]
    key = mix(rolling(raw + np.uint8(1), starts, ends) + (ends - starts).astype(np.uint64)) ^ salt[doc]
    again = later(key)
    dup_lines = np.bincount(doc[again], minlength=n_docs)
    running = np.zeros(len(w) + 1, dtype=np.int64)
    np.cumsum(points, out=running[1:])
    dup_chars = np.bincount(doc[again], weights=(running[hi] - running[lo])[again], minlength=n_docs)

    failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
    over = np.zeros(n_docs, dtype=bool)
    for share, most in zip(shares, gram_share.values()):
        over |= share > most
    over |= dup_chars / total > line_share
    return n_words, chars, symbols, dup_lines, repeat, failed, ~(failed | over), np.max(shares, axis=0) if shares else np.zeros(n_docs), dup_chars / total


def score_quality_rules(docs: DataFrame, gram_share: dict[int, float] | None = None, line_share: float = LINE_SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the repetition measures and the verdict.

    Null and empty texts have no words: all counts are 0, ``base_failed`` is true, ``kept`` false. Very long texts are
    measured whole. Repeated rows are measured each by itself; a null id stays null; an empty table gives an empty
    result; further columns of the input are ignored.
    """
    gram_share = dict(GRAM_SHARE if gram_share is None else gram_share)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                out = measure(raw[part[0] : part[-1]], part - part[0], gram_share, line_share)
                yield arrays(SCHEMA, batch.column(0).slice(lo, hi - lo), *out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DDL)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score_quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns. The verdict is found row by row beside the text, so
    no join is needed and repeated ids do not matter."""
    gram_share = dict(options.get("gram_share") or GRAM_SHARE)
    line_share = options.get("line_share", LINE_SHARE)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(at))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                kept = measure(raw[part[0] : part[-1]], part - part[0], gram_share, line_share)[6]
                yield batch.slice(lo, hi - lo).filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op9_quality_rules": op9_quality_rules}
SQL: dict[str, str] = {}
