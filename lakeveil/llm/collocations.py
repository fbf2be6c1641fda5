"""Phrase collocation mining (operator 12).

Documents are written once as blocks of normalised text. A count sketch over all n-grams, dealt over Spark by stretches of
its cells, gives an upper bound for every n-gram; cells that reach the minimum go back to the groups of blocks they came
from. A block's n-grams whose bounds (and those of all their parts) suffice compile into Aho-Corasick automata with a blank
before and after each phrase, which count every overlapping match in the block. A group, of one language, adds up the counts
of its blocks before it hands them on. The sums over all groups are exact, and the thresholds are applied to them. The width
of the sketch follows the corpus, so a group only ever sees its own candidates.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lakeveil.llm.common import _STEP, Scratch, Words, arrays, as_array, mix, rolling, text_buffer

LONGEST = 5
MIN_COUNT = 100
TOP = 2_000
SUBSUMED_PERCENT = 100
#: Bytes of text of a block (a longer piece without any separator is one block).
BLOCK_BYTES = 1 << 21
#: Cells of the sketch that one task adds up: 2**SHARD_BITS.
SHARD_BITS = 22
#: n-gram occurrences for a cell of the sketch, on average: far below any minimum worth asking for.
LOAD = 8
#: Groups of blocks for each core of the cluster. Their number stays the same, and the rows of counts with it, until groups are full.
GROUPS_A_CORE = 4
#: Bytes of text of a group, on average, at most: one task takes a whole group, its texts compressed.
GROUP_BYTES = 1 << 26
#: Tasks that groups are dealt to by hash, for each group: few groups meet in a task, and the tasks left empty cost little.
TASKS_A_GROUP = 4
#: Rows of counts that a group gathers before it adds them up.
PENDING = 1 << 18
#: Phrases of one automaton.
AUTOMATON = 50_000
#: Groups that the rows of a language are ranked in before the last ranking.
SALT = 64

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Separators of pieces become line feeds, a tab a blank.
_CLEAN = _FOLD.translate(bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n" * 9 + b" "))
_BREAKS = re.compile(rb"[ \n]*\n[ \n]*")
_BLANKS = re.compile(rb" +")

BLOCKS = pa.schema([("block", pa.int64()), ("lang", pa.string()), ("words", pa.int64()), ("size", pa.int64()), ("text", pa.binary())])
CELLS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("part", pa.int64()), ("cells", pa.binary())])
HOT = pa.schema([("lang", pa.string()), ("part", pa.int64()), ("shard", pa.int64()), ("cells", pa.binary())])
COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def normalised(text: bytes) -> bytes:
    """Pieces `` w1 w2 `` with one blank around every word, joined by line feeds; empty if there is no word."""
    text = _BLANKS.sub(b" ", _BREAKS.sub(b" \n ", text.translate(_CLEAN))).strip(b" \n")
    return b" " + text + b" " if text else b""


def _parts(text: bytes, most: int):
    """Stretches of whole pieces of about ``most`` bytes."""
    lo = 0
    while len(text) - lo > most:
        cut = text.rfind(b"\n", lo, lo + most)
        if cut <= lo:
            cut = text.find(b"\n", lo + most)
        if cut < 0:
            break
        yield text[lo:cut]
        lo = cut + 1
    yield text[lo:]


def _blocks(batches):
    """Blocks of one language each, of the rows of one task."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 36
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    total = 0

    def block(lang):
        nonlocal number, total
        text = b"\n".join(held.pop(lang))
        total -= size.pop(lang)
        number += 1
        words = text.count(b" ") - text.count(b"\n") - 1
        return arrays(BLOCKS, [number], [lang], [words], [len(text)], [pa.compress(text, codec="zstd", asbytes=True)])

    for batch in batches:
        raw, at = text_buffer(batch.column(1))
        raw = raw.tobytes()
        for i, lang in enumerate(as_array(batch.column(0)).to_pylist()):
            text = normalised(raw[at[i] : at[i + 1]])
            for part in _parts(text, BLOCK_BYTES) if text else ():
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part)
                total += len(part)
                if size[lang] >= BLOCK_BYTES:
                    yield block(lang)
                while total >= 4 * BLOCK_BYTES:  # many languages: the fullest goes first
                    yield block(max(size, key=size.get))
    for lang in list(held):
        yield block(lang)


def _texts(texts: pa.Array, sizes: pa.Array):
    """The texts of blocks, which are kept and dealt compressed."""
    for blob, size in zip(as_array(texts), as_array(sizes).to_pylist()):
        yield pa.decompress(blob.as_buffer(), decompressed_size=size, codec="zstd", asbytes=True)


class Grams:
    """Word ranges of a block and keys of its n-grams."""

    def __init__(self, text: bytes, lang: str):
        self.text = text
        self.raw = np.frombuffer(text, dtype=np.uint8)
        edges = np.r_[0, np.flatnonzero(self.raw == 10), len(self.raw)]
        self.words = Words(self.raw, edges)
        self.seed = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))

    def keys(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, key) of every n-gram inside a piece; the key depends on words and language alone."""
        at, key = self.words.grams(n)
        return at, mix(key ^ self.seed)


def cell_bits(ngrams: int) -> int:
    return max(SHARD_BITS, (max(1, ngrams) // LOAD).bit_length())


def _packed(cells: np.ndarray, counts: np.ndarray | None) -> bytes:
    """Ascending cells: the low byte of each as it is, the rest as a run of zeros before its one; counts beside them as
    byte planes. A cell takes about nine bits as long as there are fewer than 2**8 for each that is named."""
    n, high = len(cells), cells.astype(np.int64) >> 8
    ones = np.zeros(n + (int(high[-1]) + 1 if n else 0), dtype=bool)
    ones[high + np.arange(n)] = True
    data = np.packbits(ones).tobytes()
    if counts is not None:
        data += np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    head = n.to_bytes(4, "little") + len(ones).to_bytes(4, "little")
    return head + cells.astype(np.uint8).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, planes: int) -> list[np.ndarray]:
    n, wide = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:8], "little")
    size = (wide + 7) // 8
    data = np.frombuffer(pa.decompress(blob[8 + n :], decompressed_size=size + 4 * n * (planes - 1), codec="zstd", asbytes=True), dtype=np.uint8)
    high = np.flatnonzero(np.unpackbits(data[:size], count=wide)) - np.arange(n)
    out = [(high << 8) + np.frombuffer(blob, dtype=np.uint8, count=n, offset=8)]
    if planes > 1:
        out.append(np.ascontiguousarray(data[size:].reshape(4, n).T).view("<u4").ravel().astype(np.int64))
    return out


def groups_for(blocks: DataFrame, size: int) -> int:
    return max(GROUPS_A_CORE * blocks.sparkSession.sparkContext.defaultParallelism, -(-size // GROUP_BYTES))


def grouped(blocks: DataFrame, size: int) -> DataFrame:
    """Blocks (of ``size`` bytes of text in all) with the part of their language that they are counted in."""
    most = groups_for(blocks, size)
    parts = F.ceil(F.sum("size") * F.lit(most) / F.lit(max(1, size)))
    many = blocks.groupBy("lang").agg(parts.cast("long").alias("parts")).where(F.col("parts") > 1)  # fewer than ``most`` languages
    return blocks.join(F.broadcast(many), "lang", "left").withColumn("part", F.pmod(F.xxhash64("block"), F.coalesce("parts", F.lit(1)))).select("lang", "part", "size", "text")


def _sketched(bits: int, longest: int):
    def run(batches):
        for batch in batches:
            lang, part = as_array(batch.column(0)).to_pylist(), batch.column(1).to_pylist()
            for i, text in enumerate(_texts(batch.column(3), batch.column(2))):
                grams = Grams(text, lang[i])
                cells = np.concatenate([grams.keys(n)[1] for n in range(1, longest + 1)]) >> np.uint64(64 - bits)
                cells, counts = np.unique(cells, return_counts=True)
                shard = (cells >> np.uint64(SHARD_BITS)).astype(np.int64)
                local = (cells & np.uint64((1 << SHARD_BITS) - 1)).astype(np.int64)
                cut = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)] if len(shard) else np.zeros(1, np.int64)
                rows = [(int(shard[a]), lang[i], part[i], _packed(local[a:b], counts[a:b])) for a, b in zip(cut[:-1], cut[1:])]
                if rows:
                    yield arrays(CELLS, *zip(*rows))

    return run


def _hot(least: int):
    """Of a stretch of cells: those of each group whose sum over all blocks reaches ``least``."""

    def run(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SHARD_BITS, dtype=np.int64)
        blobs = table.column("cells")
        for blob in blobs:
            cells, counts = _unpacked(blob.as_buffer().to_pybytes(), 2)
            total[cells] += counts  # a blob names each cell once
        hot = total >= least
        found: dict[tuple, list[np.ndarray]] = {}
        for lang, part, blob in zip(table.column("lang").to_pylist(), table.column("part").to_pylist(), blobs):
            cells = _unpacked(blob.as_buffer().to_pybytes(), 2)[0]
            cells = cells[hot[cells]]
            if len(cells):
                found.setdefault((lang, part), []).append(cells)
        shard = table.column("shard")[0].as_py()
        rows = [(*group, shard, _packed(np.unique(np.concatenate(cells)), None)) for group, cells in found.items()]
        return pa.Table.from_batches([arrays(HOT, *zip(*rows))] if rows else [], schema=HOT)

    return run


def candidates(grams: Grams, hot: np.ndarray, bits: int, longest: int) -> list[str]:
    """Distinct phrases of the block whose own cell and whose parts' cells are all hot, in order."""
    words, out = grams.words, []
    before = np.ones(len(words) + 1, dtype=bool)
    for n in range(1, longest + 1):
        at, key = grams.keys(n)
        cell = (key >> np.uint64(64 - bits)).astype(np.int64)
        place = np.minimum(np.searchsorted(hot, cell), max(0, len(hot) - 1))
        good = (hot[place] == cell) & before[at] & before[at + 1] if len(hot) else np.zeros(len(at), dtype=bool)
        before = np.zeros(len(words) + 1, dtype=bool)
        before[at[good]] = True
        at, key = at[good], key[good]
        start, end = words.start[at], words.end[at + n - 1]
        second = rolling(grams.raw + np.uint8(1), start, end, _STEP)
        order = np.lexsort((second, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(second[order]) != 0)
        out += [grams.text[a:b] for a, b in zip(start[order[new]].tolist(), end[order[new]].tolist())]
    return [p.decode() for p in sorted(set(out))]


def counted(text: str, phrases: list[str]) -> np.ndarray:
    """Overlapping occurrences of each phrase between blanks, by automata of neighbouring phrases."""
    out = np.zeros(len(phrases), dtype=np.int64)
    for lo in range(0, len(phrases), AUTOMATON):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(phrases[lo : lo + AUTOMATON], start=lo):
            automaton.add_word(f" {phrase} ", i)
        automaton.make_automaton()
        for i, n in Counter(map(itemgetter(1), automaton.iter(text))).items():
            out[i] = n
    return out


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("phrase").aggregate([("f", "sum")]).rename_columns({"f_sum": "f"}).select(["phrase", "f"])


def _scanned(bits: int, longest: int):
    """Counts of one group of blocks, one row for each phrase."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(answers) or not len(blocks):
            return COUNTS.empty_table()
        hot = [_unpacked(a.as_buffer().to_pybytes(), 1)[0] + (shard << SHARD_BITS) for shard, a in zip(answers.column("shard").to_pylist(), answers.column("cells"))]
        hot = np.sort(np.concatenate(hot))  # a stretch answers a group once
        lang = blocks.column("lang")[0].as_py()
        sums, waiting = [], 0
        for text in _texts(blocks.column("text"), blocks.column("size")):
            grams = Grams(text, lang)
            phrases = candidates(grams, hot, bits, longest)
            sums.append(pa.table({"phrase": pa.array(phrases, pa.string()), "f": counted(grams.text.decode(), phrases)}))
            waiting += len(phrases)
            if waiting > max(PENDING, len(sums[0])):
                sums, waiting = [_added(sums)], 0
        out = _added(sums)
        return pa.table([pa.repeat(pa.scalar(lang), len(out)), *out.columns], schema=COUNTS)

    return run


def partial_counts(blocks: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, f): counts within each group of blocks, of the phrases that may occur ``least`` times in all."""
    words, size = blocks.agg(F.sum("words"), F.sum("size")).first()
    bits = cell_bits(longest * (words or 0))
    own = grouped(blocks, size or 0)
    cells = own.mapInArrow(_sketched(bits, longest), "shard long, lang string, part long, cells binary")
    hot = cells.groupBy("shard").applyInArrow(_hot(least), "lang string, part long, shard long, cells binary")
    dealt = own.repartition(TASKS_A_GROUP * groups_for(blocks, size or 0), "lang", "part")
    return dealt.groupBy("lang", "part").cogroup(hot.groupBy("lang", "part")).applyInArrow(_scanned(bits, longest), "lang string, phrase string, f long")


def phrase_counts(scratch: Scratch, blocks: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, phrase, f): exact counts of all phrases of 1 to ``longest`` words that occur ``least`` times or more."""
    found = partial_counts(blocks, longest, least)
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = MIN_COUNT, top: int = TOP, subsumed_percent: int = SUBSUMED_PERCENT, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their weakest cut.

    A null text is empty, a null language is ``und`` (and one with a text of that name). Texts without words, empty tables
    and languages without a frequent phrase give no row; repeated rows count each; ties of score go by count, then by
    phrase in byte order. A phrase is dropped if a longer frequent one that holds it reaches ``subsumed_percent`` of its
    count. Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.table("blocks", own.mapInArrow(_blocks, "block long, lang string, words long, size long, text binary"))
    sizes = blocks.groupBy("lang").agg(F.sum("words").alias("n"))
    frequent = scratch.table("frequent", phrase_counts(scratch, blocks, longest, least))
    whole = frequent.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    size = F.size("words")
    cut = F.explode(F.sequence(F.lit(1), size - 1))
    cuts = whole.select("lang", "phrase", F.col("f").alias("a"), "words", cut.alias("k")).select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")), " ").alias("tail"))
    heads = frequent.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = frequent.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in "alrn"}
    scored = scored.withColumn("top", F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"]).withColumn("bottom", wide["l"] * wide["r"])
    best = scored.withColumn("score", F.expr("top div bottom")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("b"))
    # every shorter phrase inside a candidate, with the candidate's count
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice("words", i, m), " ")))))
    longer = whole.where(size > 2).select("lang", inside.alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(38,0)") < subsumed_percent * F.col("b.a").cast("decimal(38,0)")))
    flat = kept.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALT))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d
), sizes AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang
), g AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0
), h AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM g
), f AS MATERIALIZED (SELECT lang, w[i:i + m - 1] AS phrase, count(*) AS f FROM h GROUP BY ALL HAVING count(*) >= 100
), c AS (SELECT lang, phrase, f AS a, unnest(range(1, len(phrase))) AS k FROM f WHERE len(phrase) > 1
), s AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, sizes.n,
    CAST((1000::HUGEINT * c.a * sizes.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c.k
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.phrase[1:k] JOIN f y ON y.lang = c.lang AND y.phrase = c.phrase[k + 1:]
  JOIN sizes ON sizes.lang = c.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), i AS (SELECT lang, phrase, f, unnest(range(2, len(phrase))) AS m FROM f WHERE len(phrase) > 2
), j AS (SELECT lang, phrase, f, m, unnest(range(1, len(phrase) - m + 2)) AS o FROM i
), longer AS (SELECT lang, phrase[o:o + m - 1] AS phrase, max(f) AS f FROM j GROUP BY ALL
), kept AS (
  SELECT b.lang, array_to_string(b.phrase, ' ') AS phrase, a, l, r, n, score FROM b LEFT JOIN longer ON longer.lang = b.lang AND longer.phrase = b.phrase
  WHERE longer.f IS NULL OR 100 * longer.f < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM kept QUALIFY rank <= 2000
"""
}
