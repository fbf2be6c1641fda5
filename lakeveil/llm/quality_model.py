"""Quality classifier by nearest-neighbour voting (operator 1).

Terms of a text are its words (hashed) and the shapes of its words with what repeats in it. Square roots of term shares,
weighted by rarity, are projected on the leading singular directions of the labelled sample (latent semantics). The
sample's latent vectors are broadcast; every document gets its exact cosines with all of them in blocked products, and
the nearest ones vote with their similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Words, arrays, mix, repeated, slices, text_buffer
from lakeveil.llm.labelled import collect_features, held_out, sample

#: Labelled documents that are learnt from and broadcast: the bound on what the driver and every task hold.
MOST_LABELLED = 6000
RANK = 32
NEIGHBOURS = 25
#: Power of the cosine in the vote.
SHARPNESS = 8
WORD_TERMS = 1024
SHAPE_TERMS = 1024
SHAPE_WEIGHT = 3.0
MODULUS, REMAINDER = 3, 1

SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
DDL = "doc_id long, held_out boolean, score double, predicted int"

_SALT = np.uint64(0x8CB92BA72F3D8DD7)
_UPPER, _SYMBOL, _DIGIT, _MARK, _LOWER = (np.zeros(256, dtype=bool) for _ in range(5))
_UPPER[65:91] = True
_LOWER[97:123] = True
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT[48:58] = True
_MARK[list(b"!?")] = True


def _any(table: np.ndarray, w: Words) -> np.ndarray:
    total = np.zeros(len(w.raw) + 1, dtype=np.int64)
    np.cumsum(table[w.raw], out=total[1:])
    return total[w.end] - total[w.start]


def term_shares(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the terms in each text: WORD_TERMS + SHAPE_TERMS columns, rows of zeros for texts
    without words."""
    w, n = Words(raw, offsets), len(offsets) - 1
    size = w.end - w.start
    upper, lower = _any(_UPPER, w), _any(_LOWER, w)
    shape = (upper >= 2) & (lower == 0)
    code = shape.astype(np.int64)
    for k, bit in enumerate((_any(_SYMBOL, w) > 0, _any(_MARK, w) > 0, _any(_DIGIT, w) > 0, (upper > 0) & (lower > 0))):
        code |= bit.astype(np.int64) << (k + 1)
    code = code * 4 + np.searchsorted([3, 6, 12], size)
    same = np.zeros(len(w), dtype=bool)
    if len(w) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    again = np.zeros(len(w), dtype=bool)
    at, h = w.grams(3)
    hit = at[repeated(h ^ mix(w.doc[at].astype(np.uint64) + _SALT))]
    for k in range(3):
        again[hit + k] = True
    total = np.diff(w.first)
    code = (code * 4 + 2 * same + again) * 2 + (total < 50)[w.doc]  # 32 kinds, 4 sizes, 4 sorts of repetition, short or not
    columns = WORD_TERMS + SHAPE_TERMS
    word = np.bincount(w.doc * columns + (w.hash % np.uint64(WORD_TERMS)).astype(np.int64), minlength=n * columns)
    form = np.bincount(w.doc * columns + WORD_TERMS + code, minlength=n * columns)
    return np.sqrt((word + form).reshape(n, columns) / np.maximum(total, 1)[:, None]).astype(np.float32)


@dataclass
class Model:
    projection: np.ndarray  # terms x rank, with the term weights
    vectors: np.ndarray  # sample x rank, of length 1 (or 0)
    labels: np.ndarray
    prior: float
    neighbours: int = NEIGHBOURS

    def latent(self, shares: np.ndarray) -> np.ndarray:
        v = shares @ self.projection
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, shares: np.ndarray, leave_out: bool = False) -> np.ndarray:
        """Scores of texts; ``leave_out``: the texts are the sample itself, and none votes on itself."""
        out = np.full(len(shares), self.prior)
        if not len(self.vectors):
            return out
        for lo in range(0, len(shares), 512):
            cosine = self.latent(shares[lo : lo + 512]) @ self.vectors.T
            if leave_out:
                cosine[np.arange(len(cosine)), np.arange(lo, lo + len(cosine))] = -1
            k = min(self.neighbours, cosine.shape[1])
            near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS
            out[lo : lo + 512] = ((weight * self.labels[near]).sum(1) + 0.05 * self.prior) / (weight.sum(1) + 0.05)
        return out


def fit(shares: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    columns = WORD_TERMS + SHAPE_TERMS
    prior = float(labels.mean()) if len(labels) else 0.5
    if not len(labels):
        return Model(np.zeros((columns, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    rarity = np.log((1 + len(shares)) / (1 + (shares > 0).sum(0)))
    rarity = (0.2 + rarity).astype(np.float32)
    rarity[WORD_TERMS:] *= SHAPE_WEIGHT
    a = shares * rarity
    r = np.random.default_rng(0)
    y = a @ r.normal(size=(columns, rank + 16)).astype(np.float32)
    for _ in range(4):  # subspace iteration
        q, _ = np.linalg.qr(y)
        y = a @ (a.T @ q)
    q, _ = np.linalg.qr(y)
    _, s, vt = np.linalg.svd(q.T @ a, full_matrices=False)
    v = vt[: min(rank, int((s > 1e-6).sum()) or 1)].T
    model = Model((rarity[:, None] * v).astype(np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64), prior, neighbours)
    model.vectors = model.latent(shares)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    def features(raw, offsets):
        return [x.astype(np.float16).tobytes() for x in term_shares(raw, offsets)]

    x, y = collect_features(docs, sample(labels, label, MODULUS, REMAINDER, most), features)
    shares = np.frombuffer(b"".join(x), dtype=np.float16).reshape(len(x), WORD_TERMS + SHAPE_TERMS).astype(np.float32)
    return fit(shares, y)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; labels of held-out documents are never read.

    Null and empty texts have no terms and get the share of label 1 in the sample. Without any label every score is 0.5.
    Very long texts are read whole. Repeated rows are scored each; a null id stays null and is not held out; an empty
    table gives an empty result; further columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, most))

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                score = np.round(np.clip(model.value.vote(term_shares(raw[part[0] : part[-1]], part - part[0])), 0, 1), 6)
                yield arrays(SCHEMA, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), score, (score >= 0.5).astype(np.int32))

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", MODULUS, REMAINDER).alias("held_out"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, DDL)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
