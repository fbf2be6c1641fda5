"""Fuzzy line deduplication by MinHash (operator 2).

Character shingles of a line are hashed once and dealt into bins (one-permutation MinHash, empty bins filled by fixed
probing); bands of the bins are equality keys. Lines that share a key are candidates, the exact Jaccard similarity of
their shingle sets decides, distributed union-find joins the links, and the first line of each component stays.

What lines of one key are compared with: all others of the key that they are not joined to, so no link in it is missed. A
key of up to PAIRED lines is compared all with all. A larger key first elects a centre a round; lines that are not joined
to it yet are verified against it alone, so a round costs one comparison a line however large the key is. What is still
apart after BASE_ROUNDS is dealt into blocks, each two blocks of a key meet in one cell, and a cell counts the common
shingles of all its pairs at once (``_crowd_links``). Lines of the largest component of a key meet the others only, not
each other, so the work grows with the lines of a key times those that are outside its largest component.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lakeveil.llm.common import Scratch, arrays, as_array, fresh, later, mix, rolling, slices, text_buffer
from lakeveil.llm.components import connected_components, joined_somewhat

SHINGLE = 8
SIMILARITY = 0.8
BANDS, ROWS = 6, 3
#: Two lines of fewer than SHORT characters are also alike by shorter shingles: one changed character breaks SHINGLE of the
#: long ones, too many in a line under 79 characters. They have keys of their own, of more rows: short shingles are common.
SHORT, SHORT_SHINGLE = 160, 4
SHORT_BANDS, SHORT_ROWS = 13, 5
#: Lines of a key that are compared at once, as pairs; larger keys elect centres before, one a round.
PAIRED = 16
BASE_ROUNDS = 1
#: Bytes of text that are signed at once: the numbers made of them are to stay in a core's cache.
SCANNED = 1 << 18
#: Rows (key, line) that a worker holds before it deals them, and buckets of keys a partition; neither changes what is found.
HELD, BUCKETS = 1 << 20, 16
#: Lines and characters of a block of a larger key (a longer line counts as CELL_CHARS); they bound memory, not what is compared.
CELL_LINES, CELL_CHARS = 512, 1 << 18
#: Columns of the matrices whose product counts common shingles.
CELL_STEP = 1024
#: More and stricter keys, as a yardstick for the recall of the others.
STRICT_BANDS, STRICT_ROWS, STRICT_RUNS = 48, 10, 15

_EMPTY = np.uint64((1 << 64) - 1)
_SPACES = np.isin(np.arange(33), (9, 10, 11, 12, 13, 32))


class Lines:
    """Lines with a word of several texts, as code points: which text, which line of it, a 64-bit hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        lead = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=lead[1:])
        at = lead[offsets]
        self.code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        feeds = np.flatnonzero(self.code == 10)
        start = np.sort(np.concatenate([at[:-1], feeds + 1]))  # an empty text has one empty line
        doc = np.searchsorted(at, start, side="right") - 1
        # a feed that ends a text opens an empty last line, which the next text must not be given
        end = np.minimum(np.append(feeds, len(self.code))[np.searchsorted(feeds, start)], np.append(at[1:], len(self.code))[np.minimum(doc, len(at) - 1)])
        solid = np.zeros(len(self.code) + 1, dtype=np.int64)
        np.cumsum((self.code > 32) | ~_SPACES[np.minimum(self.code, 32)], out=solid[1:])
        full = solid[np.maximum(end, start)] > solid[start]
        start, end, doc = start[full], end[full], doc[full]
        new = np.append(True, start[1:] != start[:-1]) if len(start) else np.zeros(0, bool)
        self.start, self.end, self.doc = start[new], end[new], doc[new]
        line = np.searchsorted(feeds, self.start)  # feeds before, over all texts
        self.number = line - np.searchsorted(feeds, at[self.doc])
        self.hash = mix(rolling(self.code, self.start, self.end) + (self.end - self.start).astype(np.uint64))


def keys(lines: Lines, index: np.ndarray, bands: int = BANDS, rows: int = ROWS, runs: int = 1, width: int = SHINGLE) -> np.ndarray:
    """``bands`` keys of each of the lines ``index``, from ``runs`` permutations with bands * rows bins in all."""
    start, size = lines.start[index], lines.end[index] - lines.start[index]
    count = np.maximum(size - width + 1, 1)
    base = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())
    value = _shingles(lines.code, width)[base]
    short = size < width
    value[(np.cumsum(count) - count)[short]] = lines.hash[index][short]  # one shingle: the whole line
    line = np.repeat(np.arange(len(index)), count)
    bins = bands * rows // runs
    out = np.concatenate([_least(mix(value + np.uint64(k * 0x9FB21C651E98DF25 & (1 << 64) - 1)), line, len(index), bins) for k in range(runs)], axis=1)
    band = out.reshape(-1, bands, rows)
    key = np.arange(bands, dtype=np.uint64)[None, :].repeat(len(index), 0)
    for j in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + band[:, :, j])
    return key.view(np.int64)


def _shingles(code: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of the ``size`` (a power of two) code points from each place, by doubling; zero where fewer are left."""
    h, base, width = code.astype(np.uint64), np.array([0x9E3779B97F4A7C55], np.uint64), 1
    while width < size:
        h = h[: max(0, len(h) - width)] * base + h[width:]
        base, width = base * base, 2 * width
    out = np.zeros(len(code) + 1, dtype=np.uint64)
    out[: len(h)] = h
    return out


def _least(value: np.ndarray, line: np.ndarray, n: int, bins: int) -> np.ndarray:
    """Least hash of each line in each bin."""
    least = np.full(n * bins, _EMPTY, dtype=np.uint64)
    turns = value // np.uint64(bins)  # numpy divides by a constant much faster than it takes the rest
    np.minimum.at(least, line * bins + (value - turns * np.uint64(bins)).view(np.int64), value >> np.uint64(6))
    out = least.copy()
    at = np.flatnonzero(least == _EMPTY)
    own = at % bins
    for k, probe in enumerate(_probes(bins), 1):  # every bin asks others in its own fixed order until one is filled
        if not len(at):
            break
        got = least[at - own + probe[own]]
        hit = got != _EMPTY
        out[at[hit]] = got[hit] + np.uint64(k)
        at, own = at[~hit], own[~hit]
    return out.reshape(-1, bins)


@functools.cache
def _probes(bins: int) -> np.ndarray:
    """Which bin an empty one asks at each turn."""
    turn, own = np.arange(1, 64 * bins)[:, None], np.arange(bins)[None, :]
    return (mix((own * 4096 + turn).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)


def shingle_set(line: str, width: int = SHINGLE) -> np.ndarray | set[str]:
    """Distinct shingles of a line: as sorted numbers of ``width`` (4 or 8) bytes where each character is one byte, else as
    strings."""
    if len(line) >= width:
        try:
            raw = line.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            # a number at every byte; the sort makes an aligned copy
            x = np.sort(np.ndarray((len(raw) - width + 1,), np.uint64 if width == 8 else np.uint32, raw, strides=(1,)))
            new = np.empty(len(x), dtype=bool)
            new[0] = True
            np.not_equal(x[1:], x[:-1], out=new[1:])
            return x[new]
    return {line[i : i + width] for i in range(max(1, len(line) - width + 1))}


def similar_sets(x: np.ndarray | set[str], y: np.ndarray | set[str]) -> bool:
    """Whether the Jaccard similarity reaches SIMILARITY. Sets of both forms are compared as strings."""
    if min(len(x), len(y)) < SIMILARITY * max(len(x), len(y)):
        return False
    if isinstance(x, set) != isinstance(y, set):
        x, y = (z if isinstance(z, set) else {v.tobytes().decode("latin-1") for v in z} for z in (x, y))
    if isinstance(x, set):
        both = len(x & y)
    else:
        z = np.concatenate([x, y])
        z.sort()
        both = int(np.count_nonzero(z[1:] == z[:-1]))
    return both >= SIMILARITY * (len(x) + len(y) - both)


def alike(a: str, b: str, of) -> bool:
    """Whether two lines are alike; ``of(line, width)`` gives the shingles of a line. A line has at most one shingle a
    character, so one that is too short for the shingles of the other needs none of its own."""
    long, brief = (a, b) if len(a) >= len(b) else (b, a)

    def by(width: int) -> bool:
        x = of(long, width)
        return max(1, len(brief) - width + 1) >= SIMILARITY * len(x) and similar_sets(x, of(brief, width))

    return by(SHINGLE) or (len(long) < SHORT and len(brief) >= SHORT_SHINGLE and by(SHORT_SHINGLE))


def similar(a: str, b: str) -> bool:
    return alike(a, b, shingle_set)


def short_lines(lines: Lines, index: np.ndarray) -> np.ndarray:
    """Those of the lines ``index`` that have short keys."""
    size = lines.end[index] - lines.start[index]
    return index[(size < SHORT) & (size >= SHORT_SHINGLE)]


def _scan():
    """Of each text its lines (hashes, numbers) and, as the bytes of rows (line, its keys), those signed here: ``signed`` by
    the base keys, ``brief`` by the short ones."""
    schema = pa.schema([("rk", pa.int64()), ("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("numbers", pa.list_(pa.int32())), ("signed", pa.binary()), ("brief", pa.binary())])

    def run(batches):
        np.empty(1 << 24, np.uint8)  # a block of this size once freed, glibc keeps the smaller ones of each slice for the next
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for lo, hi in slices(offsets, SCANNED):
                part = offsets[lo : hi + 1]
                x, n = Lines(raw[part[0] : part[-1]], part - part[0]), hi - lo
                first = np.flatnonzero(~later(x.hash))  # a line of this slice is signed once
                k = keys(x, first)
                brief = short_lines(x, first)
                s = keys(x, brief, SHORT_BANDS, SHORT_ROWS, width=SHORT_SHINGLE)
                at = np.searchsorted(x.doc, np.arange(n + 1))
                new, few = (np.searchsorted(x.doc[i], np.arange(n + 1)) for i in (first, brief))
                lists = lambda a, v, kind: pa.ListArray.from_arrays(pa.array(a, pa.int32()), pa.array(v, kind))
                named = lambda i, v: np.column_stack([x.hash[i].view(np.int64), v])
                yield arrays(schema, batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), lists(at, x.hash.view(np.int64), pa.int64()), lists(at, x.number, pa.int32()), _packed(new, named(first, k)), _packed(few, named(brief, s)))

    return run, "rk long, doc_id long, hashes array<long>, numbers array<int>, signed binary, brief binary"


def _packed(at: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Rows of numbers as bytes: those from at[i] to at[i + 1] are one value."""
    ends = pa.array(at * rows.shape[1] * 8, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(values, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.int64).reshape(-1, width)


def _dealt(bits: int):
    """Over (signed, brief): (bucket, rows), the rows (key, line) of a bucket as bytes. The first ``bits`` of a key name its
    bucket. Of HELD rows at a time, a line gives its keys once."""
    schema = pa.schema([("bucket", pa.int64()), ("rows", pa.binary())])

    def of(held):
        key, line = [], []
        for x in map(np.concatenate, held):
            x = x[~later(x[:, 0])]
            key.append(x[:, 1:].ravel())
            line.append(np.repeat(x[:, 0], x.shape[1] - 1))
        rows = np.stack([np.concatenate(key), np.concatenate(line)], axis=1)
        bucket = rows[:, 0] >> np.int64(64 - bits)
        # short numbers are sorted by their digits
        order = np.argsort(bucket.astype(np.int16) if bits <= 16 else bucket, kind="stable")
        bucket = bucket[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return arrays(schema, bucket[first], _packed(np.append(first, len(order)), rows[order]))

    def run(batches):
        held, n = ([], []), 0
        for batch in batches:
            for parts, column, bands in zip(held, batch.columns, (BANDS, SHORT_BANDS)):
                parts.append(_unpacked(column.to_pylist(), 1 + bands))
                n += len(parts[-1]) * bands
            if n >= HELD:
                yield of(held)
                held, n = ([], []), 0
        if n:
            yield of(held)

    return run, "bucket long, rows binary"


def _candidates():
    """Over (bucket, rows) sorted by bucket: (a, b, key, many). A key of two lines gives their pair (key null). A key of more
    gives a star to its first line and its name; ``many``: more than PAIRED. Of a bucket of more than HELD rows the crowds
    are given as they come."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("many", pa.bool_())])

    def given(key, line):
        if len(key):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            each, lead = np.repeat(size, size), np.repeat(line[first], size)
            hit = (each > 2) | ((each == 2) & (lead != line))
            yield arrays(schema, lead[hit], line[hit], pa.array(key[hit], pa.int64(), mask=each[hit] == 2), each[hit] > PAIRED)

    def sizes(key):
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        return first, np.diff(np.append(first, len(key)))

    def distinct(rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))] if len(rows) else rows

    def whole(parts):
        rows = np.concatenate(parts)
        order = np.argsort(rows[:, 0])
        first, size = sizes(rows[order, 0])
        rows = distinct(rows[order[np.repeat(size > 1, size)]])  # most keys have one line
        yield from given(rows[:, 0], rows[:, 1])

    def run(batches):
        parts, bucket, n, most = [], None, 0, HELD
        for batch in batches:
            names, values = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(edges, edges[1:]):
                if lo < hi and names[lo] != bucket:
                    if parts:
                        yield from whole(parts)
                    parts, bucket, n, most = [], names[lo], 0, HELD
                for value in values[lo:hi]:
                    parts.append(_unpacked([value], 2))
                    n += len(parts[-1])
                    if n > most:
                        rows = distinct(np.concatenate(parts))
                        first, size = sizes(rows[:, 0])
                        crowded = np.repeat(size > PAIRED, size)
                        yield from given(rows[crowded, 0], rows[crowded, 1])
                        # the first lines of a crowd stand for it
                        parts = [rows[np.arange(len(rows)) - np.repeat(first, size) <= PAIRED]]
                        n = len(parts[0])
                        most = max(HELD, 2 * n)
        if parts:
            yield from whole(parts)

    return run, "a long, b long, key long, many boolean"


def _pick():
    """Texts of the named lines: (line, text)."""
    schema = pa.schema([("line", pa.int64()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            found, names = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = text.split("\n")
                for w in wanted:
                    names.append(w["line"])
                    found.append(parts[w["number"]])
            yield arrays(schema, names, pa.array(found, pa.string()))

    return run, "line long, text string"


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(ca, cb) of the pairs (a, b, ca, cb) whose lines are alike; ca and cb name what is joined by that."""
    schema = pa.schema([("ca", pa.int64()), ("cb", pa.int64())])

    def run(batches):
        for batch in batches:
            known: dict[tuple[str, int], object] = {}

            def of(line: str, width: int):
                out = known.get((line, width))
                if out is None:
                    if len(known) > 2000:
                        known.clear()
                    out = known[line, width] = shingle_set(line, width)
                return out

            yes = [alike(x, y, of) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(pa.array(yes, pa.bool_()))

    left = texts.select(F.col("line").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("line").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("ca", "cb", "x", "y").mapInArrow(run, "ca long, cb long")


def _near(code: np.ndarray, start: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Whether the lines ``left`` are alike those ``right`` by shingles of ``width``, each with each. Shingles are told apart
    by 64-bit hashes."""
    own = np.union1d(left, right)
    count = size[own] - width + 1
    base = np.repeat(start[own] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    names, name = np.unique(_shingles(code, width)[base], return_inverse=True)
    line, name = np.divmod(np.unique(np.repeat(np.arange(len(own)), count) * len(names) + name), len(names))
    each = np.bincount(line, minlength=len(own)).astype(np.float64)
    common = np.bincount(name, minlength=len(names)) > 1
    line, name = line[common[name]], (np.cumsum(common) - 1)[name[common[name]]]
    order = np.argsort(name, kind="stable")
    line, name = line[order], name[order]
    x, y = np.searchsorted(own, left), np.searchsorted(own, right)
    both = np.zeros((len(x), len(y)))
    for lo in range(0, int(common.sum()), CELL_STEP):
        some = slice(*np.searchsorted(name, (lo, lo + CELL_STEP)))
        has = np.zeros((len(own), CELL_STEP), np.float32)  # counts up to CELL_STEP are exact
        has[line[some], name[some] - lo] = 1
        both += has[x] @ has[y].T
    return both >= SIMILARITY * (each[x][:, None] + each[y][None, :] - both)


def cell_links(texts: list[str], c: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between the components ``c`` that join all lines ``left`` and ``right`` that are alike. The counts propose a pair,
    ``similar`` decides; what earlier links join is not linked again, so there are fewer links than components."""
    if (c == c[0]).all():
        return []
    code = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    size = np.array([len(x) for x in texts])
    start = np.cumsum(size) - size
    near = np.zeros((len(left), len(right)), dtype=bool)
    for width, fits in ((SHINGLE, size >= SHINGLE), (SHORT_SHINGLE, (size >= SHORT_SHINGLE) & (size < SHORT))):
        x, y = np.flatnonzero(fits[left]), np.flatnonzero(fits[right])
        if len(x) and len(y):
            near[np.ix_(x, y)] |= _near(code, start, size, left[x], right[y], width)
    joined, out = c.copy(), []
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        while len(apart := np.flatnonzero(near[i] & (joined[right] != joined[left[i]]))):
            a, b = int(left[i]), int(right[apart[0]])
            if similar(texts[a], texts[b]):
                out.append((int(c[a]), int(c[b])))
                joined[joined == joined[b]] = joined[a]
            else:
                near[i, apart[0]] = False
    return out


def _cell_rows():
    """Over rows (key, lo, hi, block, c, text) sorted by cell (key, lo, hi): (ca, cb) of the links between its two blocks."""
    schema = pa.schema([("ca", pa.int64()), ("cb", pa.int64())])

    def of(parts):
        lo, hi, block, c = (np.concatenate([p.column(i).to_numpy(zero_copy_only=False) for p in parts]) for i in range(1, 5))
        links = cell_links([x for p in parts for x in p.column(5).to_pylist()], c, np.flatnonzero(block == lo), np.flatnonzero(block == hi))
        return arrays(schema, [a for a, _ in links], [b for _, b in links])

    def run(batches):
        parts, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
            edges = [0, *(np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1).tolist(), len(cell)]
            for lo, hi in zip(edges, edges[1:]):
                if parts and tuple(cell[lo]) != last:
                    yield of(parts)
                    parts = []
                last = tuple(cell[lo])
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield of(parts)

    return run, "ca long, cb long"


def _crowd_links(rows: DataFrame) -> DataFrame:
    """(ca, cb) for all lines of a key that are alike and not joined, of rows (key, line, c, text). The lines outside the
    largest component of a key make ``rest`` blocks, that component ``more``; each block meets all others, those of the
    largest component only the former. A key that fits into one block is one cell."""
    chars = F.least(F.length("text"), F.lit(CELL_CHARS))
    key = rows.groupBy("key", "c").agg(F.count("*").alias("n"), F.sum(chars).alias("chars")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max(F.struct("n", "chars", "c")).alias("big")).where("n > big.n")
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(n / CELL_LINES), F.ceil(size / CELL_CHARS))
    one = blocks(F.col("n"), F.col("chars")) == 1
    rest = F.when(one, 1).otherwise(blocks(F.col("n") - F.col("big.n"), F.col("chars") - F.col("big.chars")))
    more = F.when(one, 0).otherwise(blocks(F.col("big.n"), F.col("big.chars")))
    key = key.select("key", F.col("big.c").alias("big"), rest.cast("long").alias("rest"), more.cast("long").alias("more"))
    turn = F.xxhash64("line")
    block = F.when(F.col("more") == 0, F.lit(0)).when(F.col("c") == F.col("big"), F.col("rest") + F.pmod(turn, "more")).otherwise(F.pmod(turn, "rest"))
    last = F.when(F.col("block") < F.col("rest"), F.col("rest") + F.col("more") - 1).otherwise(F.col("rest") - 1)
    cells = rows.join(key, "key").withColumn("block", block.cast("long")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cells = cells.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "c", "text")
    # a number of its own: cells are few bytes but much work, so that partitions are not to be merged by size
    dealt = cells.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "lo", "hi")
    return dealt.sortWithinPartitions("key", "lo", "hi").mapInArrow(*_cell_rows())


def _cut(columns: int, at: int):
    """Rows whose last column names the lines that go out of the text in column ``at``, without that column."""

    def run(batches):
        for batch in batches:
            drops = as_array(batch.column(columns))
            texts = as_array(batch.column(at))
            found = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
            own = [batch.column(i) for i in range(columns)]
            if len(found):
                values = texts.to_pylist()
                for i in found.tolist():
                    gone = set(drops[i].as_py())
                    values[i] = "\n".join([x for k, x in enumerate(values[i].split("\n")) if k not in gone])
                own[at] = pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays(own, names=batch.schema.names[:columns])

    return run


def _shared(signed: DataFrame) -> DataFrame:
    """Candidates among the lines of (signed, brief)."""
    partitions = int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = signed.mapInArrow(*_dealt((BUCKETS * partitions).bit_length()))
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(*_candidates())


def _moved(rows: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the component in ``column`` replaced by what it was joined to."""
    r = roots.select(F.col("node").alias(column), "root")
    return rows.join(r, column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def _ordered(pairs: DataFrame) -> DataFrame:
    """Each pair (x, cx, y, cy) once, as (a, b, ca, cb)."""
    first = F.col("x") < F.col("y")
    pick = lambda p, q, name: F.when(first, F.col(p)).otherwise(F.col(q)).alias(name)
    return pairs.select(pick("x", "y", "a"), pick("y", "x", "b"), pick("cx", "cy", "ca"), pick("cy", "cx", "cb")).dropDuplicates(["a", "b"])


def _all_pairs(rows: DataFrame) -> DataFrame:
    """Lines of small keys that are not joined: each with all others of its key."""
    x, y = (rows.select("key", F.col("line").alias(n), F.col("c").alias(f"c{n}")) for n in "xy")
    return x.join(y, "key").where("x < y and cx <> cy")


def _centre_pairs(rows: DataFrame, turn: int) -> DataFrame:
    """Lines of larger keys with the centre that their key elects in this turn, if they are not joined to it."""
    centre = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min(F.struct(F.xxhash64("line", F.lit(turn)), F.col("line").alias("y"), F.col("c").alias("cy"))).alias("e"))
    centre = centre.where("low <> high").select("key", "e.y", "e.cy")
    return rows.select("key", F.col("line").alias("x"), F.col("c").alias("cx")).join(centre, "key").where("cx <> cy")


def _unjoined(rows: DataFrame) -> DataFrame:
    """Those of the rows (key, many, line, c) whose key holds more than one component."""
    open_keys = rows.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    return rows.join(open_keys, "key", "left_semi")


class _Links:
    """Verified links as they grow, and a first view of the components they make, so that what is joined is not compared
    again. The whole components are computed once, at the end."""

    def __init__(self, scratch: Scratch, texts: DataFrame):
        self.scratch, self.texts = scratch, texts
        self.links: list[DataFrame] = []  # between components of the view
        self.views: list[DataFrame] = []  # (node, root), each over the roots of those before

    def view(self, rows: DataFrame, column: str, since: int = 0) -> DataFrame:
        for moved in self.views[since:]:
            rows = _moved(rows, column, moved)
        return rows

    def join(self, pairs: DataFrame) -> bool:
        """Verify pairs (a, b, ca, cb); whether any are alike."""
        return self.add(_verified(pairs, self.texts))

    def add(self, links: DataFrame) -> bool:
        """Take links (ca, cb); whether there are any."""
        k = len(self.links)
        links = self.scratch.table(f"links-{k}", links.distinct(), free=False)
        if links.isEmpty():
            return False
        self.links.append(links)
        self.views.append(self.scratch.table(f"view-{k}", joined_somewhat(links.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), free=False))
        return True

    def settle(self, rows: DataFrame) -> None:
        """Compare what is apart in the keys (key, many, line), as the module says."""
        rows = self.scratch.table("base", self.view(rows.withColumn("c", F.col("line")), "c"), free=False)
        many = rows.where("many")
        for k in range(1, BASE_ROUNDS + 1):
            seen = len(self.views)
            pairs = _centre_pairs(many, k)
            if not self.join(_ordered(_all_pairs(_unjoined(rows.where("not many"))).unionByName(pairs) if k == 1 else pairs)):
                break
            many = self.view(many, "c", seen)
        crowd = self.scratch.table("crowd", many.select("key", "line", "c").join(self.texts, "line"), free=False)
        self.add(_crowd_links(crowd))

    def components(self) -> DataFrame:
        """(node, root) of all lines that are linked."""
        edges = [x.select(F.col("ca").alias("a"), F.col("cb").alias("b")) for x in self.links]
        edges += [x.select(F.col("node").alias("a"), F.col("root").alias("b")) for x in self.views]
        out = edges[0]
        for x in edges[1:]:
            out = out.unionByName(x)
        return connected_components(self.scratch, out, "components")


def repeated_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(rk, drop): numbers of the lines that go, for the documents (rk, doc_id, text) that lose some."""
    scanned = scratch.table("scanned", docs.select("rk", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text").mapInArrow(*_scan()))
    found = scratch.table("found", _shared(scanned.select("signed", "brief")))

    # where each line stands first and how often; a line is read from there
    spots = scanned.select("rk", "doc_id", F.explode(F.arrays_zip("hashes", "numbers")).alias("s")).select(F.col("s.hashes").alias("line"), "doc_id", "rk", F.col("s.numbers").alias("number"))
    wanted = scratch.table("wanted", found.select(F.explode(F.array("a", "b")).alias("line")).distinct().withColumn("wanted", F.lit(True)))
    held = spots.groupBy("line").agg(F.min(F.struct("doc_id", "rk", "number")).alias("first"), F.count("*").alias("n")).join(wanted, "line", "left")
    held = scratch.table("held", held.where("n > 1 or wanted"))
    places = held.where("wanted").groupBy(F.col("first.rk").alias("rk")).agg(F.collect_list(F.struct("line", F.col("first.number").alias("number"))).alias("lines"))  # of one text: bounded by it
    places = scratch.table("places", places)
    texts = scratch.table("texts", docs.select("rk", "text").join(places, "rk").select("text", "lines").mapInArrow(*_pick()).dropDuplicates(["line"]))

    # pairs, and the lines of shared keys against the first of each
    links = _Links(scratch, texts)
    links.join(found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb")))
    links.settle(found.where("key is not null").select("key", "many", F.col("b").alias("line")))
    roots = scratch.table("roots", links.components()) if links.links else docs.sparkSession.createDataFrame([], "node long, root long")
    scratch.drop("texts", "found", "wanted", "places", "crowd", "base")

    # the first occurrence of a component stays
    held = held.join(roots.select(F.col("node").alias("line"), "root"), "line", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "line"))
    held = scratch.table("rooted", held)
    keeper = held.groupBy("root").agg(F.min("first").alias("keep"))
    keeper = scratch.table("keeper", held.join(keeper, "root").select("line", F.col("keep.rk").alias("keep_rk"), F.col("keep.number").alias("keep_number")))
    gone = spots.join(keeper, "line").where("rk <> keep_rk or number <> keep_number")
    return scratch.table("gone", gone.groupBy("rk").agg(F.collect_set("number").alias("drop")))  # of one text: bounded by it


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated and nearly repeated lines taken out of ``text``; new last column ``n_lines_removed``.

    A line stands between line feeds; one without a word is never a repeat and stays. Lines are alike by shingles of
    SHINGLE characters, two lines under SHORT characters also by those of SHORT_SHINGLE: one changed character leaves a
    line of 39 characters or more alike. Lines of fewer than SHORT_SHINGLE characters are repeats only if equal. Of each component the first line, by
    doc_id (a null id comes first) and place, stays. A null text stays null; an empty one stays empty. Very long texts
    and lines are read whole. Rows with equal doc_id and text are one document given several times and get one result.
    An empty table gives an empty result; further columns are passed on as they are, but for one named
    ``n_lines_removed``, which is replaced.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rk, drop = fresh(docs, "rk", "drop")
    key = F.xxhash64(F.col("doc_id").cast("long"), "text")
    own = docs.select(key.alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    gone = repeated_lines(own, scratch)
    names = [c for c in docs.columns if c.lower() != "n_lines_removed"]
    out = docs.withColumn(rk, key).join(gone.select(F.col("rk").alias(rk), F.col("drop").alias(drop)), rk, "left")
    out = out.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == "text" else F.col(f"`{c}`") for c in names], F.coalesce(F.size(drop), F.lit(0)).alias("n_lines_removed"), F.col(drop))
    return out.mapInArrow(_cut(len(names) + 1, names.index("text")), T.StructType(out.schema.fields[:-1]))


def op2_lines(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines_removed").cast("long").alias("n_lines_removed"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op2_lines": op2_lines}
SQL: dict[str, str] = {}
