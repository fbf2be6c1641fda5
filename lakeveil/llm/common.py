"""Shared helpers of the corpus operators: scratch tables, Arrow text access, word and n-gram hashes.

Scratch tables are Parquet files in the folder that the cluster names in ``spark.checkpoint.dir``. They cut the lineage
of a step (a lost executor costs a re-read, not a re-computation) and can be dropped as soon as nothing reads them.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step works on; bounds the memory of a Python worker whatever the batch size.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_U64 = np.uint64
_BASE = _U64(0x9E3779B97F4A7C55)
_STEP = _U64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see. Only a local session may leave it unset: it has one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lakeveil-scratch")
    return path.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        have.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Named intermediate tables of one operator run. What a returned table still reads goes when the session ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)  # of folders that are there only

    def table(self, name: str, df: DataFrame, free: bool = True, compression: str | None = None) -> DataFrame:
        """Write ``df`` and return the table read back. ``free``: let Spark drop the shuffle files of finished steps."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        if free:
            self.free()
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)

    def free(self) -> None:
        """Shuffle files go when the driver collects the plans that made them; ask for that now."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def as_array(col) -> pa.Array:
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def text_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of an Arrow string column; nulls are empty."""
    col = as_array(col)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges of rows of about ``most`` bytes each; a row is never cut."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[int(base)] = have
    return have[:n]


_INVERSE = {int(b): _U64(pow(int(b), -1, 1 << 64)) for b in (_BASE, _STEP)}


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = _BASE) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end] for every range, from one prefix sum."""
    n = len(values)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * _powers(base, n), out=total[1:])
    return (total[ends] - total[starts]) * _powers(_INVERSE[int(base)], n + 1)[starts]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte ranges, the text of each word, a 64-bit hash of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, hashed: bool = True):
        n = len(raw)
        solid = ~_SPACE[raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
        before &= ~edge[:n]
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        after &= ~edge[1:]
        self.raw, self.offsets = raw, offsets
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        #: words of text d are those from first[d] to first[d + 1]
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        if hashed:
            self.hash = mix(rolling(raw + np.uint8(1), self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.start)

    def grams(self, n: int, base: np.uint64 = _STEP) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of every window of n words that lies within one text."""
        at = np.arange(max(0, len(self.start) - n + 1))
        if len(at):
            at = at[self.doc[: len(at)] == self.doc[n - 1 :]]
        return at, mix(rolling(self.hash, at, at + n, base))

    def points(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.zeros(len(self.raw) + 1, dtype=np.int64)
        np.cumsum((self.raw & 0xC0) != 0x80, out=lead[1:])
        return lead[self.end] - lead[self.start]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur more than once."""
    if len(keys) < 2:
        return np.zeros(len(keys), dtype=bool)
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def later(keys: np.ndarray) -> np.ndarray:
    """Which of the keys stand somewhere before, too."""
    out = np.zeros(len(keys), dtype=bool)
    at = np.flatnonzero(repeated(keys))
    if len(at):
        order = np.argsort(keys[at], kind="stable")
        s = keys[at][order]
        out[at[order[1:]][s[1:] == s[:-1]]] = True
    return out


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows of ``width`` words starting at ``at``."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:n]) > 0


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for every d."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def arrays(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
