import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lakeveil.llm import packing, quality_rules
from lakeveil.llm.common import text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.text(alphabet="ab #|\n\té", max_size=60), max_size=8)


def plain(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(grams), [False] * len(words)
    for i, g in enumerate(grams):
        if often[g] > 1:
            hit[i : i + 3] = [True] * 3
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit)


def share(text, n):
    words = WORD.findall(text)
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit[i : i + n] = [True] * n
        seen.add(g)
    return sum(len(w) for w, h in zip(words, hit) if h) / max(1, sum(map(len, words)))


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_measures_equal_plain_counts(texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    out = quality_rules.measure(raw, offsets, {5: 0.15}, 0.2)
    assert [tuple(int(c[i]) for c in out[:5]) for i in range(len(texts))] == [plain(t) for t in texts]
    assert np.allclose(out[7], [share(t, 5) for t in texts])


def test_rules_on_edge_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "x"), (2, None, "x"), (3, "", "x"), (4, "same line here\n" * 40, "x"), (None, good, "x"), (1, good, "x"), (6, " ".join(f"w{i}" for i in range(300_000)), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    got = {(r.doc_id, r.n_words, r.kept) for r in quality_rules.score_quality_rules(df).collect()}
    assert got == {(1, 80, True), (2, 0, False), (3, 0, False), (4, 120, False), (None, 80, True), (6, 300_000, True)}
    assert quality_rules.score_quality_rules(df).count() == 7
    assert quality_rules.score_quality_rules(df.limit(0)).count() == 0
    kept = quality_rules.filter_quality(df)
    assert kept.columns == df.columns and kept.count() == 4


@pytest.fixture(scope="module")
def encoder():
    return packing.CachedEncoder(str(packing.public_tokenizers.path(packing.VOCABULARY)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1'! \n\t\xa0é　ß", max_size=30), max_size=5))
def test_cached_ids_equal_the_tokenizer(encoder, texts):
    raw, offsets = text_buffer(pa.array(texts, pa.string()))
    odd = [bool(packing._ODD[raw[a:b]].any()) for a, b in zip(offsets, offsets[1:])]
    assert encoder.encode(texts, odd) == [encoder.whole(t) for t in texts]


def test_special_token_text(encoder):
    assert encoder.encode(["a <|endoftext|> b"], [False]) == [encoder.whole("a <|endoftext|> b")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([0, 2]))
def test_packing_is_whole_and_tight(lengths, slack):
    docs = [(i, np.arange(i * 1000, i * 1000 + n, dtype="<u4").tobytes()) for i, n in enumerate(lengths)]
    windows = list(packing.pack(docs, 16, slack))
    back = {}
    for w in windows:
        size = sum(len(p[2]) // 4 for p in w)
        assert size <= 16 and (16 - size <= slack or size & (size - 1) == 0)
        for row, start, ids, total in w:
            assert total == lengths[row] and len(ids)
            back.setdefault(row, []).append((start, ids))
    assert {r: b"".join(x for _, x in sorted(v)) for r, v in back.items()} == dict(docs)


def test_pack_documents(spark, encoder):
    text = "The quick brown fox. " * 1500
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (3, ""), (None, "a b\nc")], "doc_id long, text string").repartition(2)
    rows = packing.pack_documents(df).collect()
    whole = np.frombuffer(encoder.whole(text) + b"\1\0\0\0", dtype="<u4")
    for r in rows:
        if r.doc_id == 1:
            assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes())
    assert sum(r.length for r in rows) == len(whole) + 3 + len(encoder.whole("a b\nc")) // 4 + 1
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
    assert packing.pack_documents(df.limit(0)).count() == 0
