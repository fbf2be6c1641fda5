"""Names by a sequence tagger: an averaged perceptron over hashed word features, decoded over overlapping windows.

The features of a token are those of the words around it, one by one, so every distinct word of a batch is scored once and
the rest is gathering and adding. All windows of a batch are decoded together; a token takes its label from the window
whose centre is nearest. The model is fitted on a bounded sample of marked texts and goes to the tasks as one array.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakeveil.operators.recognizers import FOUND, finding

BUCKETS = 1 << 16
#: Words before and after a token that tell of it.
REACH = 2
#: Tokens of a window, and those at either end that are left to the next one.
WINDOW, OVERLAP = 64, 16
#: Marked texts that a model is fitted on at most.
MOST_MARKED = 4_000
ROUNDS = 6
#: Parts of the tokens whose spelling is hidden in a step of fitting: the token's own, those around it. So the model
#: learns from places and shapes, too, and knows what to do with names that it has not seen.
HIDDEN, HIDDEN_AROUND = 0.7, 0.25
OUTSIDE = "O"
#: Words whose scores a task keeps, about 400 bytes each.
MOST_KNOWN = 300_000

_TOKEN = re.compile(r"\w+(?:[-’']\w+)*|[^\w\s]")
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string())]))
_DDL = "array<struct<start:int,end:int,entity_type:string>>"


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Words and single signs of a text, and where they begin."""
    found = [(m[0], m.start()) for m in _TOKEN.finditer(text)]
    return [w for w, _ in found], [s for _, s in found]


def shape(word: str) -> str:
    """Capitals, small letters and figures of a word, runs of a kind as one."""
    if word.isalpha():  # most words, told by plain tests
        if word.islower():
            return "x"
        if word[0].isupper() and word[1:].islower():
            return "Xx"
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word[:24])
    out = ""
    for k in kinds:
        if not out.endswith(k):
            out += k
    return out


#: Check sums of the names of features: that of ``name=value`` goes on from its name's.
_NAMED = {name: zlib.crc32(f"{name}=".encode()) for name in ("w", "s", "p2", "p3", "e2", "e3", "e4", "l", "c")}


def _sums(word: str) -> list[int]:
    low, crc = word.lower(), zlib.crc32
    values = (low, shape(word), low[:2], low[:3], low[-2:], low[-3:], low[-4:], str(min(len(word), 12)), f"{word[:1].isupper()}{word.isupper()}")
    return [crc(v.encode("utf-8", "replace"), n) for v, n in zip(values, _NAMED.values())]


def word_features(word: str) -> np.ndarray:
    """Numbers of what a word is like, the same ones for every place it can stand at; an empty word is none."""
    return np.array(_sums(word), dtype=np.uint64)


#: Which of them are the spelling of a word.
SPELLING = [0, 2, 3, 4, 5, 6]


def placed(features: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of word features for a word that stands ``offset`` tokens away."""
    return (((features + np.uint64((offset + REACH + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def decode(emission: np.ndarray, length: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of every token of sequences (n, width, labels) of given lengths; ties go to the smaller label. What lies
    beyond a length is label 0 by form only."""
    n, width, k = emission.shape
    score = emission[:, 0] + first
    back = np.zeros((n, width, k), dtype=np.int16)
    for t in range(1, width):
        through = score[:, :, None] + trans[None]
        back[:, t] = through.argmax(axis=1)
        score = np.where((t < length)[:, None], through.max(axis=1) + emission[:, t], score)
    out = np.zeros((n, width), dtype=np.int16)
    label = score.argmax(axis=1)
    rows = np.arange(n)
    for t in range(width - 1, -1, -1):
        inside = t < length
        out[inside, t] = label[inside]
        label = np.where(inside & (t > 0), back[rows, t, label], label)
    return out


def windows(n: int) -> list[tuple[int, int, int, int]]:
    """(start, end, own start, own end) of the windows over n tokens: own are the tokens whose nearest centre it has."""
    step, out, lo = WINDOW - 2 * OVERLAP, [], 0
    while True:
        hi = min(lo + WINDOW, n)
        own = lo + OVERLAP if lo else 0
        out.append((lo, hi, own, n if hi == n else hi - OVERLAP))
        if hi == n:
            return out
        lo += step


@dataclass
class Tagger:
    labels: list[str]  # O, then B- and I- of each kind
    weights: np.ndarray  # (BUCKETS, labels)
    trans: np.ndarray  # from label, to label
    first: np.ndarray

    def __post_init__(self):
        self._clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scored")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._clear()

    def _clear(self) -> None:
        """No word is known; row 0 is for none."""
        self.known: dict[str, int] = {}
        self.scored = self._scores([""])

    def _scores(self, words: list[str]) -> np.ndarray:
        """What words add to the scores around them: (words, places, labels)."""
        out = np.empty((len(words), 2 * REACH + 1, len(self.labels)))
        for lo in range(0, len(words), 1 << 14):
            own = np.array([_sums(w) for w in words[lo : lo + (1 << 14)]], dtype=np.uint64)
            for o in range(-REACH, REACH + 1):
                out[lo : lo + len(own), o + REACH] = self.weights[placed(own, o)].sum(axis=1)
        return out

    def emissions(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores (tokens, labels) of several texts. Words stay known from one call to the next, up to a bound."""
        if len(self.known) > MOST_KNOWN:
            self._clear()
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.scored), len(self.scored) + len(new))))
            self.scored = np.concatenate([self.scored, self._scores(new)])
        known, out = self.known, []
        for words in texts:
            ids = np.zeros(len(words) + 2 * REACH, dtype=np.int64)
            ids[REACH : REACH + len(words)] = [known[w] for w in words]
            out.append(sum((self.scored[ids[o : o + len(words)], o] for o in range(2 * REACH + 1)), np.zeros((len(words), len(self.labels)))))
        return out

    def tagged(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Labels of the tokens of several texts."""
        scores = self.emissions(texts)
        spans = [(i, *w) for i, s in enumerate(scores) if len(s) for w in windows(len(s))]
        out = [np.zeros(len(s), dtype=np.int16) for s in scores]
        for lo in range(0, len(spans), 4096):
            part = spans[lo : lo + 4096]
            e = np.zeros((len(part), WINDOW, len(self.labels)))
            for r, (i, a, b, _, _) in enumerate(part):
                e[r, : b - a] = scores[i][a:b]
            best = decode(e, np.array([b - a for _, a, b, _, _ in part]), self.trans, self.first)
            for r, (i, a, _, c, d) in enumerate(part):
                out[i][c:d] = best[r, c - a : d - a]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the names in texts; null and empty texts have none."""
        cut = [tokens(t or "") for t in texts]
        out = []
        for own, (words, starts) in zip(self.tagged([w for w, _ in cut]), cut):
            # tokens of names and those before them: what lies between is outside any
            at = np.flatnonzero((own != 0) | np.append(own[1:] != 0, False)[: len(own)]).tolist()
            out.append(entities([self.labels[own[i]] for i in at], [words[i] for i in at], [starts[i] for i in at]))
        return out


def entities(labels: list[str], words: list[str], starts: list[int]) -> list[tuple[int, int, str]]:
    """Runs of one kind as spans. An I- of another kind, or after O, begins a span of its own."""
    out: list[tuple[int, int, str]] = []
    before = OUTSIDE
    for label, word, start in zip(labels, words, starts):
        if label != OUTSIDE:
            if label[0] == "I" and before[2:] == label[2:]:
                out[-1] = (out[-1][0], start + len(word), label[2:])
            else:
                out.append((start, start + len(word), label[2:]))
        before = label
    return out


def marked_labels(words: list[str], starts: list[int], marks: list[tuple[int, int, str]]) -> list[str]:
    """Labels of tokens by marks (start, end, kind) that do not overlap; a token belongs to a mark that it touches."""
    out, at = [], 0
    marks = sorted(marks)
    begun = -1
    for word, start in zip(words, starts):
        while at < len(marks) and marks[at][1] <= start:
            at += 1
        if at < len(marks) and marks[at][0] < start + len(word):
            out.append(("I-" if begun == at else "B-") + marks[at][2])
            begun = at
        else:
            out.append(OUTSIDE)
    return out


def hidden(ids: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Feature buckets (tokens, features of all places) with the spelling of some words left out: bucket BUCKETS is none."""
    n, places = len(ids), 2 * REACH + 1
    out = ids.reshape(n, places, -1).copy()
    drop = rng.random((n, places)) < np.where(np.arange(places) == REACH, HIDDEN, HIDDEN_AROUND)
    out[:, :, SPELLING] = np.where(drop[:, :, None], BUCKETS, out[:, :, SPELLING])
    return out.reshape(n, -1)


def train(texts: list[str], marks: list[list[tuple[int, int, str]]], rounds: int = ROUNDS, seed: int = 0) -> Tagger:
    """A tagger from texts and their marks. No marks at all: one that finds nothing."""
    kinds = sorted({k for own in marks for _, _, k in own})
    labels = [OUTSIDE, *(f"{b}-{k}" for k in kinds for b in "BI")]
    number = {x: i for i, x in enumerate(labels)}
    k = len(labels)
    weights, trans, first = np.zeros((BUCKETS + 1, k)), np.zeros((k, k)), np.zeros(k)
    sums = [np.zeros_like(x) for x in (weights, trans, first)]
    cache: dict[str, np.ndarray] = {}
    data = []
    for text, own in zip(texts, marks):
        words, starts = tokens(text)
        gold = np.array([number[x] for x in marked_labels(words, starts, own)], dtype=np.int64)
        pad = [""] * REACH + words + [""] * REACH
        for w in pad:
            if w not in cache:
                cache[w] = word_features(w)
        if words:
            data.append((np.concatenate([placed(np.stack([cache[w] for w in pad[REACH + o : REACH + o + len(words)]]), o) for o in range(-REACH, REACH + 1)], axis=1), gold))
    rng, step = np.random.default_rng(seed), 1
    for _ in range(rounds):
        for i in rng.permutation(len(data)):
            ids, gold = data[i]
            ids = hidden(ids, rng)
            best = decode(weights[ids].sum(axis=1)[None], np.array([len(gold)]), trans, first)[0].astype(np.int64)
            wrong = np.flatnonzero(best != gold)
            if len(wrong):
                for own, sign in ((gold, 1.0), (best, -1.0)):
                    for target, at in ((0, (ids[wrong], own[wrong][:, None])), (1, (own[:-1], own[1:])), (2, (own[:1],))):
                        np.add.at((weights, trans, first)[target], at, sign)
                        np.add.at(sums[target], at, sign * step)
                weights[BUCKETS] = sums[0][BUCKETS] = 0
            step += 1
    weights, trans, first = (x - s / step for x, s in zip((weights, trans, first), sums))
    return Tagger(labels, weights[:BUCKETS].astype(np.float32).astype(np.float64), trans, first)


def fit(marked: DataFrame, most: int = MOST_MARKED, rounds: int = ROUNDS) -> Tagger:
    """A tagger from rows (text, marks: array of start, end, entity_type): ``most`` of them, the same ones each time. Null texts
    and texts without marks of their own teach what is no name."""
    rows = marked.select(F.coalesce(F.col("text"), F.lit("")).alias("text"), "marks").orderBy(F.xxhash64("text"), "text").limit(most).collect()
    return train([r.text for r in rows], [[(m.start, m.end, m.entity_type) for m in r.marks or [] if m.start < m.end] for r in rows], rounds)


def names_of(tagger: Tagger, score: float = 0.85) -> Callable[[Column], Column]:
    """The tagger as a name model for ``Settings.names``: a text column to findings. Null text: none."""

    @F.arrow_udf(_DDL)
    def tag(text: pa.Array) -> pa.Array:
        found: list = []
        for lo in range(0, len(text), 256):
            found += tagger.spans(text.slice(lo, 256).to_pylist())
        return pa.array([[{"start": a, "end": b, "entity_type": k} for a, b, k in own] for own in found], _SPANS)

    def names(text: Column) -> Column:
        return F.transform(tag(text), lambda s: finding(s.start, s.end, s.entity_type, F.substring(text, s.start + 1, s.end - s.start), F.lit(score), F.lit("tagger"), F.lit(True))).cast(FOUND)

    return names


def tag_names(docs: DataFrame, tagger: Tagger, text: str = "text", into: str = "names") -> DataFrame:
    """``docs`` with the names of a text column as findings; a column of that name is replaced. No shuffle: each row by itself."""
    return docs.withColumn(into, names_of(tagger)(F.col(text)))
