"""Near-duplicate documents by SimHash (operator 3).

Fingerprints of 64 bits link at two or fewer differing bits. Cut into two segments, two such fingerprints have a segment
that differs in at most one bit, so they share a one-wildcard variant of it. Variants are indexed, equality-joined and
verified on the whole fingerprint. A variant that many fingerprints share is not joined: its members go to the ball of
one-bit neighbours instead. Two fingerprints differ in at most two bits exactly if their balls meet, and all that
share a ball point are linked with each other, so a star for each ball point keeps every connection without pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Scratch, Words, arrays, fresh, slices, text_buffer
from lakeveil.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 64
#: Variants shared by more fingerprints than this go the way of the balls, which has no pairs.
PAIRED = 16


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Signed 64-bit fingerprints of texts given as bytes and offsets."""
    upper = (raw >= 65) & (raw <= 90)
    raw = raw + (upper * np.uint8(32)).astype(np.uint8)
    w, n_docs = Words(raw, offsets, hashed=False), len(offsets) - 1
    sizes = w.end - w.start
    # the words of all texts, one space apart
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(at[-1], 32, dtype=np.uint8)
    solid = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    inside = np.cumsum(solid[:-1]) > 0
    joined[np.flatnonzero(np.repeat(np.tile([True, False], len(w)), np.stack([sizes, np.ones_like(sizes)], 1).ravel()))] = raw[inside]
    counts = np.diff(w.first)
    take = np.where(counts == 0, 0, np.maximum(counts - SHINGLE + 1, 1))
    doc = np.repeat(np.arange(n_docs), take)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(take) - take, take) + w.first[doc]
    last = np.minimum(first + SHINGLE, w.first[doc + 1]) - 1
    blob, hash_of = joined.tobytes(), xxhash.xxh64_intdigest
    h = np.array([hash_of(blob[a:b], SEED) for a, b in zip(at[first].tolist(), (at[last] + sizes[last]).tolist())], dtype=np.uint64)
    out = np.zeros(n_docs, dtype=np.uint64)
    full = np.flatnonzero(take)
    if len(full):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, (np.cumsum(take) - take)[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * ones > take[full, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out.view(np.int64)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                part = offsets[lo : hi + 1]
                yield arrays(SCHEMA, batch.column(0).slice(lo, hi - lo), fingerprints(raw[part[0] : part[-1]], part - part[0]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bit(k: int) -> int:
    """2**k as a signed 64-bit number."""
    return (1 << k) - (1 << 64 if k == 63 else 0)


def variants(fp: np.ndarray) -> np.ndarray:
    """The 64 one-wildcard variants of each fingerprint: the segment without the bit, its position and the segment's
    number in one positive key."""
    out = np.empty((len(fp), BITS), dtype=np.int64)
    for s in (0, 1):
        half = (fp >> (32 * s)) & 0xFFFFFFFF
        for i in range(32):
            out[:, 32 * s + i] = (half & ~(1 << i)) << 6 | (32 * s + i)
    return out


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _index(paired: int):
    """Variants of a batch. Of a key that more than ``paired`` fingerprints of the batch share, paired + 1 are enough to
    tell that it is crowded; its members are named by rows with negative keys. So a crowd is cut down before the shuffle."""

    def run(batches):
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            key, own = variants(fp).ravel(), np.repeat(fp, BITS)
            order = np.argsort(key)
            key, own = key[order], own[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(key)))
            rank = np.arange(len(key)) - np.repeat(first, size)
            crowd = np.unique(own[np.repeat(size, size) > paired])
            keep = rank <= paired
            yield arrays(schema, np.concatenate([key[keep], -1 - (crowd & 0x7FFFFFFFFFFFFFFE)]), np.concatenate([own[keep], crowd]))

    return run


def _verify(paired: int):
    """Over rows sorted by key: verified pairs of keys with up to ``paired`` fingerprints; (fp, fp) for the members of
    other keys. A key is read as a stream, never gathered."""

    def flush(key, own):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(key)))
        each = np.repeat(size, size)
        crowded = (each > paired) | (key < 0)
        a, b = [own[crowded]], [own[crowded]]
        small = (each > 1) & ~crowded
        key, own = key[small], own[small]
        for d in range(1, min(paired, len(key))):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            i = i[np.bitwise_count((own[i] ^ own[i + d]).view(np.uint64)) <= 2]
            a.append(np.maximum(own[i], own[i + d]))
            b.append(np.minimum(own[i], own[i + d]))
        return arrays(PAIR, np.concatenate(a), np.concatenate(b))

    def run(batches):
        key, own = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            k, f = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            # of a crowd that goes on from the last batch, paired + 1 rows stand for those already given out
            key, own = np.append(key, k), np.append(own, f)
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            cut = len(key) if len(key) - last > paired else last
            yield flush(key[:cut], own[:cut])
            keep = slice(cut - paired - 1, cut) if cut > last else slice(last, len(key))
            key, own = key[keep], own[keep]
        yield flush(key, own)

    return run


def links(scratch: Scratch, fps: DataFrame, paired: int = PAIRED) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (column fp) at two or fewer
    differing bits."""
    index = fps.select("fp").mapInArrow(_index(paired), "key long, fp long")
    found = scratch.table("found", index.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(paired), "a long, b long"))
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_bit(k))) for k in range(BITS)])
    points = crowded.select("fp", F.explode(ball).alias("point"))
    centre = scratch.table("points", points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("point", "b"))
    stars = points.join(centre, "point").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return found.where("a <> b").unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, paired: int = PAIRED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row.

    Null and empty texts have fingerprint zero and link like any other. Repeated rows keep their number; a null id stays
    null and is passed over when the smallest id is taken (a component of null ids alone has a null component_id). Very
    long texts are read whole. An empty table gives an empty result. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table("prints", with_fingerprints(docs, id_col, text_col))
    distinct = scratch.table("distinct", prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = links(scratch, distinct.select("fp"), paired)
    roots = scratch.table("roots", connected_components(scratch, edges))
    named = roots.join(distinct, roots.node == distinct.fp).select("node", "root", "low")
    ids = named.groupBy("root").agg(F.min("low").alias("component"))
    by_print = scratch.table("named", named.join(ids, "root").select(F.col("node").alias("fp"), "component"))
    whole = distinct.join(by_print, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id"))
    whole = scratch.table("whole", whole)
    out = prints.join(whole, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, paired: int = PAIRED) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id.

    Rows of that id with different texts all stay, as nothing says which of them the id means; equal rows stay once. Rows
    without an id cannot be told apart and are all kept. Null and empty texts are alike and leave one row. Very long texts are
    read whole, an empty table gives an empty result, further columns are passed on.
    """
    (own,) = fresh(docs, "text_hash")
    found = near_duplicates(docs, paired)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").withColumn(own, F.xxhash64("text")).dropDuplicates(["doc_id", own])
    return out.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op3_simhash": op3_simhash}
SQL: dict[str, str] = {}
