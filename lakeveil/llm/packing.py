"""Packing into fixed windows by online sum-of-squares (operator 10).

Every Spark partition packs its own documents: a tail of a document goes to the fill level that makes the sum of the
squared counts of partially filled windows smallest, the counts standing in one array of levels. Full windows leave at
once; what is open when the partition ends is completed by cutting. One scan, no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from lakeveil.llm.common import arrays, slices, text_buffer

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
#: Windows that lack at most so many ids when a partition ends are padded; the others are completed by cutting.
SLACK = 8
#: Chunks of text whose ids a worker keeps (about 250 bytes each).
CACHE = 500_000

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

# Bytes that can belong to white space other than single blanks and line feeds: such texts take the plain way.
_ODD = np.zeros(256, dtype=bool)
_ODD[:32] = True
_ODD[10] = False
_ODD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


class CachedEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode``, with the ids of chunks between blanks kept.

    The splitting pattern of byte-level BPE never joins what stands on two sides of white space, but for one blank that
    goes with the word after it. So a text whose white space is single blanks and single line feeds is encoded chunk by
    chunk: " word" and, at the start of a line, "word". All other texts are encoded whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.feed = self.whole("\n")
        self.feed_id = int.from_bytes(self.feed, "little")
        #: which ids are of tokens that start with a blank ("\u0120" in the byte alphabet)
        self.starts = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.starts[[i for token, i in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, bare: set[str], spaced: set[str]) -> None:
        """Encode new chunks in one text: blanks start the ones, line feeds part the others."""
        if spaced:
            words = list(spaced)
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            self._keep(self.spaced, words, ids, np.flatnonzero(self.starts[ids]), 0)
        if bare:
            words = list(bare)
            ids = np.array(self.tokenizer.encode_batch_fast(["\n" + "\n".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            self._keep(self.bare, words, ids, np.flatnonzero(ids == self.feed_id), 1)

    def _keep(self, known: dict[str, bytes], words: list[str], ids: np.ndarray, at: np.ndarray, skip: int) -> None:
        if len(at) != len(words):
            raise RuntimeError("the tokenizer joined chunks that white space parts")
        blob, ends = ids.tobytes(), (4 * np.append(at[1:], len(ids))).tolist()
        known.update((w, blob[a:b]) for w, a, b in zip(words, (4 * (at + skip)).tolist(), ends))

    def encode(self, texts: list[str], odd: list[bool]) -> list[bytes]:
        lines: list[list[list[bytes]] | None] = []
        bare, spaced, open_lines = set(), set(), []
        first, rest = self.bare.get, self.spaced.get
        for text, o in zip(texts, odd):
            if o or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(s in text for s in self.special):
                lines.append(None)
                continue
            found = []
            for line in text.split("\n") if text else []:
                words = line.split(" ")
                ids = list(map(rest, words))
                ids[0] = first(words[0])
                if None in ids:
                    if ids[0] is None:
                        bare.add(words[0])
                        ids[0] = b""
                    new = [i for i, x in enumerate(ids) if x is None]
                    spaced.update([words[i] for i in new])
                    open_lines.append((words, ids, new))
                found.append(ids)
            lines.append(found)
        self.learn(bare, spaced)
        known, feed = self.spaced, self.feed
        for words, ids, new in open_lines:
            if not ids[0]:
                ids[0] = self.bare[words[0]]
            for i in new:
                ids[i] = known[words[i]]
        out = [self.whole(t) if x is None else feed.join([b"".join(ids) for ids in x]) for t, x in zip(texts, lines)]
        if len(self.bare) + len(known) > CACHE:  # what came first is what is frequent; later chunks are not kept
            for kept, new in ((self.bare, bare), (known, spaced)):
                for x in new:
                    del kept[x]
        return out


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder_for(path: str) -> CachedEncoder:
    """One encoder for each Python worker, so that its cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


class SumOfSquares:
    """Open windows by fill level. ``place`` returns windows that are full now as lists of pieces.

    A piece is (row, start, ids as bytes, ids of the document).
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def place(self, piece: tuple) -> list | None:
        size, full = len(piece[2]) // 4, self.window
        if size == full:
            return [piece]
        # Taking a window from level h to h + size changes the sum of squares by 2 (n[h + size] - n[h]) + 2; a new
        # window (level 0) and a full one (level ``full``) leave out the side that is not counted.
        n = self.count
        cost = 2 * (n[size:] - n[: full - size + 1]) + 2
        cost[0] = 2 * n[size] + 1
        cost[-1] = 1 - 2 * n[full - size]
        cost[1:][n[1 : full - size + 1] == 0] = np.iinfo(np.int64).max
        h = int(np.argmin(cost))
        pieces = self.open[h].pop() if h else []
        pieces.append(piece)
        if h:
            n[h] -= 1
        if h + size == full:
            return pieces
        n[h + size] += 1
        self.open[h + size].append(pieces)
        return None

    def close(self, slack: int = SLACK) -> Iterator[list]:
        """All windows still open: nearly full ones as they are; the fullest of the others are filled up with pieces cut
        from the emptiest; the last one is cut into powers of two, so that it needs no padding."""
        full = self.window
        rest = [(h, p) for h in range(full - 1, 0, -1) for p in self.open[h]]
        self.count[:] = 0
        self.open = [[] for _ in range(full)]
        lo, hi, spare = 0, len(rest) - 1, []
        while lo <= hi:
            h, pieces = rest[lo]
            lo += 1
            if full - h <= slack:
                yield pieces
                continue
            gap = full - h
            while gap:
                if not spare:
                    if lo > hi:
                        break
                    spare = rest[hi][1][::-1]
                    hi -= 1
                row, start, ids, total = spare.pop()
                take = min(gap, len(ids) // 4)
                pieces.append((row, start, ids[: 4 * take], total))
                gap -= take
                if 4 * take < len(ids):
                    spare.append((row, start + take, ids[4 * take :], total))
            if not gap:
                yield pieces
            else:
                spare = pieces[::-1]
        while spare:
            size = 1 << (min(full, sum(len(p[2]) // 4 for p in spare)).bit_length() - 1)
            pieces = []
            while size:
                row, start, ids, total = spare.pop()
                take = min(size, len(ids) // 4)
                pieces.append((row, start, ids[: 4 * take], total))
                size -= take
                if 4 * take < len(ids):
                    spare.append((row, start + take, ids[4 * take :], total))
            yield pieces


def pack(documents: Iterable[tuple[int | None, bytes]], window: int = WINDOW, slack: int = SLACK) -> Iterator[list]:
    """Windows, each a list of pieces, for documents given as (id, little-endian unsigned 32-bit ids)."""
    state = SumOfSquares(window)
    for row, ids in documents:
        total = len(ids) // 4
        for start in range(0, total, window):
            done = state.place((row, start, ids[4 * start : 4 * min(total, start + window)], total))
            if done:
                yield done
    yield from state.close(slack)


def pack_documents(docs: DataFrame, window: int = WINDOW, slack: int = SLACK, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; see the module for the method.

    Null and empty texts have no ids of their own and are packed as the closing id alone. Very long texts fill windows
    of their own; their tail is packed like a short text. Repeated rows are packed each, a null id stays null, an empty
    table gives an empty result, further columns are ignored. ``sequence_id`` holds the partition in its upper half:
    it is unique in a result; another partitioning of the input gives another, equally valid packing.
    """
    path = tokenizer_path or public_tokenizers.path(VOCABULARY)
    closing = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        encoder = encoder_for(str(path))
        base = TaskContext.get().partitionId() << 32
        found: list[tuple] = []
        number = 0

        def ids():
            for batch in batches:
                raw, offsets = text_buffer(batch.column(1))
                names = batch.column(0).to_pylist()
                for lo, hi in slices(offsets):
                    part = offsets[lo : hi + 1] - offsets[lo]
                    own = raw[offsets[lo] : offsets[hi]]
                    odd = np.zeros(len(own) + 1, dtype=np.int64)
                    np.cumsum(_ODD[own], out=odd[1:])
                    texts = [own[a:b].tobytes().decode("utf-8") for a, b in zip(part.tolist(), part[1:].tolist())]
                    for name, x in zip(names[lo:hi], encoder.encode(texts, (odd[part[1:]] > odd[part[:-1]]).tolist())):
                        yield name, x + closing

        for pieces in pack(ids(), window, slack):
            offset = 0
            for row, start, own, total in pieces:
                n = len(own) // 4
                found.append((row, start, n, zlib.crc32(own), total, base + number, offset))
                offset += n
            number += 1
            if len(found) > 20_000:
                yield arrays(SCHEMA, *zip(*found))
                found = []
        if found:
            yield arrays(SCHEMA, *zip(*found))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DDL)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_packing": op10_packing}
SQL: dict[str, str] = {}
