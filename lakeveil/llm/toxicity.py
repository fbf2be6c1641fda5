"""Toxicity by a counterfactual-regularised classifier (operator 8).

Logistic regression over the words of a text and their beginnings (hashed, present or not). In each labelled sentence that
names a group of people, the name is swapped for the others of its kind; the loss adds the squared change of the score that
a swap makes, so that a name by itself does not make a text toxic. Every sentence that holds a name weighs the same.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Words, arrays, mix, rolling, slices, text_buffer
from lakeveil.llm.labelled import collect_features, held_out, sample

#: Labelled documents that are learnt from: the bound on what the driver holds.
MOST_LABELLED = 8000
#: Features that get a weight.
MOST_FEATURES = 4000
BUCKETS = 1 << 20
#: Bytes of the beginnings of words that are features of their own.
BEGINNINGS = (4, 5, 6, 7, 8, 9, 10, 12)
THRESHOLD = 0.3
RIDGE = 3e-5
SWAP_PENALTY = 1.0
MODULUS, REMAINDER = 4, 2

#: Names of groups of people, in the languages of the corpus. A name is swapped for the others of its line, so that a
#: sentence stays one.
IDENTITY_TERMS = [
    line.split()
    for line in """
women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees foreigners natives asians africans europeans americans lesbians gays seniors teenagers
woman man girl boy muslim christian jew hindu buddhist atheist immigrant refugee foreigner native asian african european american lesbian senior teenager
gay straight bisexual transgender disabled blind deaf elderly young black white
frauen männer mädchen jungen muslime christen juden hindus buddhisten atheisten einwanderer ausländer flüchtlinge schwule lesben behinderte rentner
frau mann muslim christ jude hindu buddhist atheist ausländer flüchtling schwuler lesbe behinderter
femmes hommes filles garçons musulmans chrétiens juifs hindous bouddhistes athées immigrés étrangers réfugiés homosexuels lesbiennes handicapés
mujeres hombres niñas niños musulmanes cristianos judíos hindúes budistas ateos inmigrantes extranjeros refugiados homosexuales lesbianas discapacitados
""".strip().splitlines()
]
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
DDL = "doc_id long, held_out boolean, score double, predicted int"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words and beginnings in each text, every pair once, sorted. Words lose what is no letter or
    digit at their ends and the case of A-Z and of the letters À to Þ."""
    accented = np.zeros(len(raw), dtype=bool)
    accented[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    raw = raw + ((((raw >= 65) & (raw <= 90)) | accented) * np.uint8(32)).astype(np.uint8)
    w = Words(raw, offsets, hashed=False)
    solid = np.flatnonzero(_LETTER[raw])
    start = np.append(solid, len(raw))[np.searchsorted(solid, w.start)]
    end = np.append(-1, solid)[np.searchsorted(solid, w.end)] + 1
    full = start < np.minimum(end, w.end)
    start, end, doc = start[full], end[full], w.doc[full]
    size = end - start
    keys, docs = [rolling(raw, start, end) + size.astype(np.uint64)], [doc]
    for n in BEGINNINGS:
        long = size > n
        keys.append(rolling(raw, start[long], start[long] + n) * np.uint64(3) + np.uint64(n))
        docs.append(doc[long])
    bucket = (mix(np.concatenate(keys)) % np.uint64(BUCKETS)).astype(np.int64)
    pairs = np.unique(np.concatenate(docs) * BUCKETS + bucket)
    return pairs // BUCKETS, (pairs % BUCKETS).astype(np.int32)


def bags(texts: list[str]) -> list[np.ndarray]:
    """Sorted features of each text."""
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    doc, bucket = features(raw, offsets)
    return np.split(bucket, np.searchsorted(doc, np.arange(1, len(texts))))


#: Letters that a search without case takes for a plain one, but whose small form is another.
_ALIKE = str.maketrans("\u0130\u0131\u017f\u212a", "iisk")


def _folded(name: str) -> str:
    return name.translate(_ALIKE).lower()


class Swaps:
    """Names in sentences and what takes their place. Upper and lower case are one, dotted and dotless i, long s and the
    Kelvin sign included."""

    def __init__(self, terms: list[list[str]]):
        self.others: dict[str, set[str]] = {}
        for line in terms:
            for t in line:
                self.others.setdefault(_folded(t), set()).update(x for x in line if _folded(x) != _folded(t))
        names = "|".join(map(re.escape, sorted(self.others, key=lambda t: (-len(t), t))))
        self.pattern = re.compile(rf"(?<!\w)(?:{names})(?!\w)", re.I) if names else None

    def of(self, text: str) -> Counter:
        """(features a swap takes, features it brings), as bytes: weight. The swaps of one name in one sentence weigh one."""
        out: Counter = Counter()
        if self.pattern is None or not self.pattern.search(text):
            return out
        for sentence in _SENTENCE.split(text):
            for name in {_folded(m) for m in self.pattern.findall(sentence)}:
                others = sorted(self.others.get(name, ()))
                if not others:
                    continue
                own, *changed = bags([sentence, *(re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", lambda _: x, sentence, flags=re.I) for x in others)])
                for bag in changed:
                    out[np.setdiff1d(own, bag).tobytes(), np.setdiff1d(bag, own).tobytes()] += 1 / len(changed)
        return out


@dataclass
class Model:
    weights: np.ndarray  # of all buckets
    bias: float

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        doc, bucket = features(raw, offsets)
        total = np.bincount(doc, weights=self.weights[bucket], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(own_bags: list[np.ndarray], labels: np.ndarray, penalty: float = SWAP_PENALTY, swapped: Counter | None = None, rounds: int = 500) -> Model:
    """``swapped``: swaps of the labelled sentences by weight, see ``Swaps.of``."""
    weights = np.zeros(BUCKETS, dtype=np.float64)
    ones, n = int(labels.sum()), len(labels)
    if not 0 < ones < n:
        return Model(weights, float(np.log((ones + 0.5) / (n - ones + 0.5))))
    doc = np.repeat(np.arange(n), [len(b) for b in own_bags])
    bucket = np.concatenate(own_bags)
    hits = np.bincount(bucket, weights=labels[doc], minlength=BUCKETS)
    misses = np.bincount(bucket, minlength=BUCKETS) - hits
    # likelihood ratio of "the feature goes with the label"; kept where it beats the luckiest of that many features
    total, expected = hits + misses, (hits + misses) * ones / n
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(hits > 0, hits * np.log(hits / expected), 0) + np.where(misses > 0, misses * np.log(misses / (total - expected)), 0))
        g2 = np.nan_to_num(g2)
    chosen = np.argsort(-g2, kind="stable")[:MOST_FEATURES]
    chosen = chosen[g2[chosen] > 2 * np.log(max(2, int((total > 0).sum())))]
    number = np.full(BUCKETS, -1, dtype=np.int64)
    number[chosen] = np.arange(len(chosen))
    keep = number[bucket] >= 0
    doc, own = doc[keep], number[bucket[keep]]
    # only what a swap changes counts, and of that only what has a weight
    pairs, share = [], []
    for (a, b), w in sorted((swapped or {}).items()):
        a, b = (number[np.frombuffer(x, dtype=np.int32)] for x in (a, b))
        a, b = a[a >= 0], b[b >= 0]
        if len(a) + len(b):
            pairs.append((a, b))
            share.append(w)
    row = np.concatenate([np.repeat(i, len(a) + len(b)) for i, (a, b) in enumerate(pairs)]) if pairs else np.zeros(0, np.int64)
    col = np.concatenate([np.append(a, b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.append(np.ones(len(a)), -np.ones(len(b))) for a, b in pairs]) if pairs else np.zeros(0)
    share = np.array(share) / max(1e-12, sum((swapped or {}).values()))

    x, bias = np.zeros(len(chosen)), float(np.log(ones / (n - ones)))
    m, v, mb, vb = np.zeros_like(x), np.zeros_like(x), 0.0, 0.0
    for t in range(1, rounds + 1):  # Adam on the whole sample
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weights=x[own], minlength=n) + bias, -30, 30)))
        g = np.bincount(own, weights=(p - labels)[doc], minlength=len(x)) / n + RIDGE * x
        if len(pairs):
            change = np.bincount(row, weights=sign * x[col], minlength=len(pairs))
            g += 2 * penalty * np.bincount(col, weights=sign * (share * change)[row], minlength=len(x))
        gb = float((p - labels).mean())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.99**t
        x -= 0.1 * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= 0.1 * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    weights[chosen] = x
    return Model(weights, bias)


def _packed(terms: list[list[str]]):
    """Features of texts with the swaps in their sentences, as one value a text."""
    swaps = Swaps(terms)

    def pack(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        doc, bucket = features(raw, offsets)
        at, blob = np.searchsorted(doc, np.arange(len(offsets))), raw.tobytes()
        return [pickle.dumps((bucket[a:b].tobytes(), dict(swaps.of(blob[lo:hi].decode())))) for a, b, lo, hi in zip(at, at[1:], offsets, offsets[1:])]

    return pack


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, penalty: float = SWAP_PENALTY, terms: list[list[str]] = IDENTITY_TERMS) -> Model:
    x, y = collect_features(docs, sample(labels, label, MODULUS, REMAINDER, most), _packed(terms))
    once = {b: (pickle.loads(b), y) for b, y in zip(x, y)}  # copies of a text count once
    swapped: Counter = Counter()
    for (_, own), _ in once.values():
        swapped.update(own)
    return fit([np.frombuffer(b, dtype=np.int32) for (b, _), _ in once.values()], np.array([y for _, y in once.values()], dtype=np.int64), penalty, swapped)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, penalty: float = SWAP_PENALTY) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; labels of held-out documents are never read.

    Null and empty texts have no features: their score is that of the bias alone. Without labels of both kinds every
    score is the same. Very long texts are read whole. Repeated rows are scored each; a null id stays null and is not
    held out; an empty table gives an empty result; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, most, penalty))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                score = np.round(model.value.score(raw[part[0] : part[-1]], part - part[0]), 6)
                yield arrays(SCHEMA, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), score, (score >= THRESHOLD).astype(np.int32))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, DDL)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
