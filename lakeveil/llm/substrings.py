"""Repeated passages (operator 4): seed and extend on winnowed anchors.

Of the 15 six-word grams in a window of 20 words the first one with the smallest hash is its anchor; equal windows have
equal anchors at equal places. Documents are joined on the anchors that more than one of them holds (seeds). A seed is
matched with the earliest holder of its anchor and the match is extended both ways, word by word, as far as a window with
this anchor reaches; a maximal match of 20 words or more is a repeat, and longer passages go on in their next seeds. That
settles all windows but those that a later holder has and the earliest one has not: these are looked up by their hashes.
A window is a repeat if it also starts earlier: in a document that comes before, or earlier in the same.

Texts cross the network once, to the seeds of their document. Seeds are matched inside a task first, then by anchor; an
anchor of very many holders is split, and each part has its own earliest holder. No group is ever held in memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Scratch, Words, arrays, covered, later, mix, per_text, slices, text_buffer

LENGTH = 20
GRAM = 6

_SALT = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)  # base of the second window hash


#: Anchors that a task remembers; when there are more it starts anew, and the shuffle by anchor does the rest.
REMEMBERED = 100_000
#: Holders of an anchor in one part.
PART = 2_000


def anchors(words: Words, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, first word of the anchor of each, its hash): the first gram of least hash in the window."""
    n = len(words) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix(_windows(words.hash, gram))
    width, have, low = length - gram + 1, 1, np.arange(n)
    while have < width:  # first least of 2, 4, 8 grams, then of two overlapping stretches
        step = min(have, width - have)
        x, y = (low[:-step], low[step:]) if len(low) > step else (low[:0], low[:0])
        low = np.where(h[y] < h[x], y, x)
        have += step
    at = np.arange(len(low))
    at = at[words.doc[at] == words.doc[at + length - 1]]
    return at, low[at], h[low[at]]


def _windows(h: np.ndarray, n: int, base: np.uint64 = _STEP) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), dtype=np.uint64)
    for j in range(n):
        out = out * base + h[j : j + len(out)]
    return out


class Block:
    """Some texts with their windows."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.n_docs = length, gram, len(offsets) - 1
        self.words = Words(raw, offsets)
        self.at, self.place, self.anchor = anchors(self.words, length, gram)
        self.doc = self.words.doc[self.at]
        self.window = mix(_windows(self.words.hash, length))[self.at]
        #: windows that also start earlier in their own document
        self.again = later(self.window ^ mix(self.doc.astype(np.uint64) + _SALT))

    def keep(self, repeats: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """(words removed, SHA-256 of the words kept) of each text; ``repeats``: first words of repeated windows."""
        w, out, hit = self.words, [], covered(repeats, self.length, len(self.words))
        removed = per_text(hit, w.first)
        blob = w.raw.tobytes()
        for d in range(self.n_docs):
            own = blob[w.offsets[d] : w.offsets[d + 1]].split()
            if removed[d]:
                own = [x for x, h in zip(own, hit[w.first[d] : w.first[d + 1]].tolist()) if not h]
            out.append(hashlib.sha256(b" ".join(own)).hexdigest())
        return removed, out


def _blocks(batch, column: int, length: int, gram: int):
    raw, offsets = text_buffer(batch.column(column))
    for lo, hi in slices(offsets):
        part = offsets[lo : hi + 1]
        yield lo, hi, Block(raw[part[0] : part[-1]], part - part[0], length, gram)


def _lists(values: np.ndarray, doc: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list for each text; ``doc`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _scan(length: int, gram: int):
    """Each text by itself: its words, its own repeats, its distinct anchors."""
    schema = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("anchors", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for lo, hi, b in _blocks(batch, 2, length, gram):
                removed, sha = b.keep(b.at[b.again])
                new = np.append(True, (b.anchor[1:] != b.anchor[:-1]) | (b.doc[1:] != b.doc[:-1])) if len(b.anchor) else np.zeros(0, bool)
                value, doc = b.anchor[new], b.doc[new]
                order = np.lexsort((value, doc))
                value, doc = value[order], doc[order]
                new = np.append(True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])) if len(value) else np.zeros(0, bool)
                yield arrays(schema, batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), np.diff(b.words.first), removed, pa.array(sha, pa.string()), _lists(value[new].view(np.int64), doc[new], hi - lo, pa.int64()))

    return run, "rk long, doc_id long, n_words long, n_removed long, kept_sha256 string, anchors array<long>"


class Seeds:
    """Occurrences of anchors with the words around them, as far as a window with the anchor reaches: ``reach`` words on
    both sides as 32-bit hashes, and how many of them the text has (``left``, ``right``). Bit o of ``open``: the window that
    starts o words before the anchor is one of this anchor, and not settled yet."""

    def __init__(self, strip: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.strip, self.left, self.right = strip, left, right

    @classmethod
    def of(cls, b: Block, index: np.ndarray) -> tuple[Seeds, np.ndarray, np.ndarray, np.ndarray]:
        """(seeds, anchor, place, open) of the windows ``index`` of a block."""
        w, reach = b.words, b.length - b.gram
        cut = np.flatnonzero(np.append(True, b.place[index][1:] != b.place[index][:-1]))  # places ascend with the windows
        bits = np.int32(1) << (b.place[index] - b.at[index]).astype(np.int32)
        place = b.place[index][cut]
        doc = w.doc[place]
        around = np.clip(place[:, None] + np.arange(-reach, b.gram + reach), 0, len(w) - 1)
        strip = (w.hash >> np.uint64(32)).astype(np.uint32)[around]
        return cls(strip, np.minimum(place - w.first[doc], reach), np.minimum(w.first[doc + 1] - place - b.gram, reach)), b.anchor[index][cut], place, np.bitwise_or.reduceat(bits, cut)

    def take(self, index) -> Seeds:
        return Seeds(self.strip[index], self.left[index], self.right[index])

    def room(self) -> np.ndarray:
        return (self.left * 256 + self.right).astype(np.int32)


def extended(x: Seeds, y: Seeds, reach: int) -> np.ndarray:
    """Extend the match of each x with the y beside it both ways; bit o: the window o words before the anchor lies in the
    maximal match."""
    same = x.strip == y.strip

    def run(hit: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.minimum(np.where(hit.all(axis=1), hit.shape[1], hit.argmin(axis=1)), most) if hit.shape[1] else np.zeros(len(hit), np.int64)

    left = run(same[:, :reach][:, ::-1], np.minimum(x.left, y.left))
    right = run(same[:, same.shape[1] - reach :], np.minimum(x.right, y.right))
    whole = same[:, reach : same.shape[1] - reach].all(axis=1) & (left + right >= reach)
    bits = (np.int64(1) << (left + 1)) - (np.int64(1) << (reach - np.minimum(right, reach)))
    return np.where(whole, bits, 0).astype(np.int32)


def _bits(open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, o) of all bits that are set."""
    hit = (open_[:, None] >> np.arange(31)) & 1
    return np.nonzero(hit)


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _strips(col, width: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, width), np.uint32)
    size = 4 * width
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[size * col.offset : size * (col.offset + len(col))].view(np.uint32).reshape(-1, width)


def _seed(length: int, gram: int):
    """Seeds of documents (rk, doc_id, text, anchors to look at, parts of each anchor). Those that the earliest holder in
    this task settles are given as ``starts`` of repeated windows; the others go on, for the shuffle by anchor and part."""
    schema = pa.schema([("anchor", pa.int64()), ("part", pa.int32()), ("parts", pa.int32()), ("doc_id", pa.int64()), ("rk", pa.int64()), ("place", pa.int32()), ("open", pa.int32()), ("room", pa.int32()), ("strip", pa.binary())])
    reach, width = length - gram, 2 * length - gram

    def run(batches):
        known: dict[int, int] = {}  # anchor: number of its earliest holder so far
        store = Seeds(np.zeros((REMEMBERED, width), np.uint32), np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64))
        owner = np.zeros((REMEMBERED, 2), np.int64)
        for batch in batches:
            for lo, hi, b in _blocks(batch, 2, length, gram):
                rk, ids = (batch.column(i).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for i in (0, 1))
                lists = batch.column(3).slice(lo, hi - lo)
                seed_doc = np.repeat(np.arange(hi - lo), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                salt = mix(np.arange(hi - lo, dtype=np.uint64) + _SALT)
                flat = lists.flatten()
                marked = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ salt[seed_doc]
                order = np.argsort(marked)
                marked, of_mark = marked[order], flat.field(1).to_numpy(zero_copy_only=False)[order]
                if not len(marked):
                    continue
                key = b.anchor ^ salt[b.doc]
                near = np.minimum(np.searchsorted(marked, key), len(marked) - 1)
                index = np.flatnonzero(~b.again & (marked[near] == key))
                if not len(index):
                    continue
                seeds, anchor, place, open_ = Seeds.of(b, index)
                doc = b.words.doc[place]
                parts = of_mark[near[index]][np.flatnonzero(np.append(True, b.place[index][1:] != b.place[index][:-1]))]
                me = np.stack([ids[doc], rk[doc]], axis=1)
                if len(known) + len(anchor) > REMEMBERED:
                    known.clear()
                # match with the earliest holder that this task has seen before this block, or else within it
                names, earlier = anchor.view(np.int64).tolist(), np.full(len(anchor), -1)
                for i, (name, mine) in enumerate(zip(names, me.tolist())):
                    j = known.get(name)
                    if j is None:
                        j = len(known)
                        if j < REMEMBERED:
                            known[name] = j
                    elif owner[j].tolist() < mine:
                        earlier[i] = j
                        continue
                    if j < REMEMBERED:
                        store.strip[j], store.left[j], store.right[j], owner[j] = seeds.strip[i], seeds.left[i], seeds.right[i], mine
                at = np.flatnonzero(earlier >= 0)
                # a holder may have been replaced since it was chosen, by a document that is earlier still
                hit = extended(seeds.take(at), store.take(earlier[at]), reach) & open_[at]
                open_[at] &= ~hit
                row, o = _bits(hit)
                own = place[at[row]] - b.words.first[doc[at[row]]] - o
                local = (place - b.words.first[doc]).astype(np.int32)
                if len(own):
                    none = np.zeros(len(own), np.int64)
                    yield arrays(schema, pa.nulls(len(own), pa.int64()), none, none, me[at[row], 0], me[at[row], 1], own, none, none, pa.nulls(len(own), pa.binary()))
                left = np.flatnonzero(open_)
                if len(left):
                    part = (mix(me[left, 1].view(np.uint64)) % parts[left].astype(np.uint64)).astype(np.int32)
                    yield arrays(schema, anchor[left].view(np.int64), part, parts[left], me[left, 0], me[left, 1], local[left], open_[left], seeds.room()[left], _binary(seeds.strip[left]))

    return run, "anchor long, part int, parts int, doc_id long, rk long, place int, open int, room int, strip binary"


def _match(length: int, gram: int):
    """Over seeds sorted by (anchor, part, doc_id, rk): matched with the first of their group. ``hash`` null: ``start`` is
    the start of a repeated window; else a window that is not settled by that."""
    schema = pa.schema([("rk", pa.int64()), ("start", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("more", pa.int32())])
    reach, width = length - gram, 2 * length - gram

    def run(batches):
        last = None  # (anchor, part), document and seed of the first of the group at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part, parts, ids, rk, place, open_, room = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(8))
            seeds = Seeds(_strips(batch.column(8), width), (room >> 8).astype(np.int64), (room & 255).astype(np.int64))
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))
            group = np.cumsum(new) - 1
            lead = np.flatnonzero(new)
            first, owner = seeds.take(lead), np.stack([ids[lead], rk[lead]], axis=1)
            leads = new.copy()
            if last is not None and last[0] == (anchor[0], part[0]):
                leads[0] = False
                first.strip, first.left, first.right = first.strip.copy(), first.left.copy(), first.right.copy()
                first.strip[0], first.left[0], first.right[0], owner[0] = *last[2], last[1]
            g = int(group[-1])
            last = ((anchor[-1], part[-1]), owner[g].copy(), (first.strip[g].copy(), first.left[g], first.right[g]))
            other = (owner[group] != np.stack([ids, rk], axis=1)).any(axis=1)
            hit = np.where(other, extended(seeds, first.take(group), reach) & open_, 0)
            row, o = _bits(hit)
            if len(row):
                yield arrays(schema, rk[row], place[row] - o, pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()))
            # the first seed of a whole anchor needs no look-up: all others were held against it
            row, o = _bits(np.where(~leads | (parts > 1), open_ & ~hit, 0))
            for lo in range(0, len(row), 1 << 16):
                r, q = row[lo : lo + (1 << 16)], o[lo : lo + (1 << 16)]
                h = np.zeros(len(r), np.uint64)
                more = np.zeros(len(r), np.uint64)
                for j in range(length):
                    word = seeds.strip[r, reach - q + j].astype(np.uint64)
                    h = h * _STEP + word
                    more = more * _OTHER + (word ^ (word >> np.uint64(15)))
                yield arrays(schema, rk[r], place[r] - q, ids[r], mix(h).view(np.int64), (mix(more) >> np.uint64(32)).astype(np.uint32).view(np.int32))

    return run, "rk long, start int, doc_id long, hash long, more int"


def _finish(length: int, gram: int):
    schema = pa.schema([("rk", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for lo, hi, b in _blocks(batch, 1, length, gram):
                lists = batch.column(2).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                removed, sha = b.keep(np.concatenate([b.at[b.again], lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + b.words.first[doc]]))
                yield arrays(schema, batch.column(0).slice(lo, hi - lo), removed, pa.array(sha, pa.string()))

    return run, "rk long, n_removed long, kept_sha256 string"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    Null and empty texts have no words; a text under ``length`` words has no window. Very long texts are read whole, one at
    a time; a worker holds some 100 bytes for each of its words. Rows with equal doc_id and text are one document given
    several times: each gets the result of that document. Rows with equal doc_id and other texts are ordered by a hash of
    the text; a null id comes first and stays null. An empty table gives an empty result; further columns are ignored.
    Words are compared by 32 bits of their hashes, 20 at a time, windows that are looked up by 96 bits: equal ones are always
    found, others taken for equal only by a coincidence of so many bits.
    """
    if not 0 <= length - gram < 31:
        raise ValueError("a window is up to 30 words longer than an anchor")
    scratch = Scratch(docs.sparkSession, "substrings")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col).cast("long"), text).alias("rk"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    scanned = scratch.table("scanned", rows.mapInArrow(*_scan(length, gram)))

    held = scanned.select("rk", F.explode("anchors").alias("anchor"))
    shared = held.groupBy("anchor").agg(F.min("rk").alias("low"), F.max("rk").alias("high"), F.count("*").alias("n")).where("low <> high")
    shared = scratch.table("shared", shared.select("anchor", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    seeds = held.join(shared, "anchor").groupBy("rk").agg(F.collect_set(F.struct("anchor", "parts")).alias("seeds"))  # of one text: bounded by it
    seeds = scratch.table("seeds", seeds)

    first = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")
    suspects = scratch.table("suspects", rows.join(seeds, "rk").select("rk", first, "text", "seeds"))
    scratch.drop("shared", "seeds")
    found = scratch.table("found", suspects.mapInArrow(*_seed(length, gram)))
    ordered = found.where("anchor is not null").repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "rk")
    matched = scratch.table("matched", ordered.mapInArrow(*_match(length, gram)))
    open_ = matched.where("hash is not null")
    earliest = open_.groupBy("hash", "more").agg(F.min(F.struct("doc_id", "rk")).alias("first"), F.min("rk").alias("low"), F.max("rk").alias("high")).where("low <> high")
    again = open_.join(earliest.select("hash", "more", F.col("first.rk").alias("first")), ["hash", "more"]).where("rk <> first").select("rk", "start")
    repeats = found.where("anchor is null").select("rk", F.col("place").alias("start")).unionByName(matched.where("hash is null").select("rk", "start")).unionByName(again)
    repeats = scratch.table("repeats", repeats.groupBy("rk").agg(F.collect_list("start").alias("starts")))  # of one text: bounded by it
    scratch.drop("found", "matched")

    done = suspects.select("rk", "text").join(repeats, "rk").mapInArrow(*_finish(length, gram))
    done = scratch.table("done", done.groupBy("rk").agg(F.max("n_removed").alias("removed"), F.max("kept_sha256").alias("sha")))
    scratch.drop("suspects", "repeats")
    out = scanned.select("rk", "doc_id", "n_words", "n_removed", "kept_sha256").join(done, "rk", "left")
    return out.select("doc_id", "n_words", F.coalesce("removed", "n_removed").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_substrings": op4_substrings}
SQL: dict[str, str] = {}
