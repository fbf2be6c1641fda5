"""Collocations against a plain count of all n-grams."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakeveil.llm import collocations as C

SCHEMA = "text string, lang string, block string, f int, rank int"


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)) if w]


def plain(rows, longest, least, top, percent=100):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    out = []
    frequent = {k: v for k, v in f.items() if v >= least}
    longer = Counter()
    for (lang, p), v in frequent.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i : i + m]] = max(longer[lang, p[i : i + m]], v)
    for (lang, p), a in frequent.items():
        if len(p) < 2 or 100 * longer[lang, p] >= percent * a:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), l, r, n[lang]))
    found = []
    for lang in n:
        for rank, (_, s, a, p, l, r, size) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            found.append((lang, rank, p.decode(), -a, l, r, size, -s))
    return sorted(found)


def asked(spark, rows, parts=3, **how):
    df = spark.createDataFrame([(t, g, "mine", 1, 2) for t, g in rows], SCHEMA).repartition(parts)
    return sorted(tuple(r) for r in C.collocations(df, **how).collect())


def texts(seed, count):
    rng = random.Random(seed)
    words = ["a", "b", "A", "é", "ß", "x-y", "\x0bb", "ab", " ", "b.b", "İ", "\x85", "a\x00"]
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \n\r ", "!?", "\x0c"]
    return [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(count)]


ODD = [(None, "en"), ("", "en"), (" \t\n.", "fr"), ("word", "it"), ("a a a a a a a a", "en"), ("a a a a a a a a", "en")]


@pytest.mark.parametrize("how", [dict(longest=5, least=3, top=20), dict(longest=3, least=2, top=3), dict(longest=4, least=4, top=1000, subsumed_percent=60)])
def test_equals_plain_count(spark, how):
    rows = texts(1, 120) + ODD
    assert asked(spark, rows, **how) == plain(rows, how["longest"], how["least"], how["top"], how.get("subsumed_percent", 100))


def test_many_blocks_and_stretches(spark, monkeypatch):
    """Small blocks, a sketch of many stretches and several automata give the same."""
    rows = texts(2, 80) + [("a b c. " * 3000 + "q" * 5000, "en")]
    monkeypatch.setattr(C, "AUTOMATON", 7)
    monkeypatch.setattr(C, "BLOCK_BYTES", 300)
    monkeypatch.setattr(C, "cell_bits", lambda n: C.SHARD_BITS + 6)
    assert asked(spark, rows, longest=4, least=3, top=50) == plain(rows, 4, 3, 50)


def test_full_sketch_only_costs_time(spark):
    """Bounds that let everything through change nothing: the automata count, not the sketch."""
    grams = C.Grams(C.normalised(b"a b a b c. b a"), "en")
    everything = np.arange(1 << 8)
    phrases = C.candidates(grams, everything, 8, 3)
    assert phrases == sorted({"a", "b", "c", "a b", "b a", "b c", "a b a", "b a b", "a b c"})
    assert dict(zip(phrases, C.counted(grams.text.decode(), phrases)))["b a"] == 2


def test_cells_are_packed_without_loss():
    rng = np.random.default_rng(0)
    cells = np.unique(rng.integers(0, 1 << C.SHARD_BITS, 5000))
    counts = rng.integers(1, 1 << 31, len(cells))
    got = C._unpacked(C._packed(cells, counts), 2)
    assert (got[0] == cells).all() and (got[1] == counts).all()
    assert len(C._unpacked(C._packed(cells[:0], None), 1)[0]) == 0


def test_no_rows(spark):
    assert asked(spark, [], least=1) == []
    assert asked(spark, [(None, None), ("", "en")], least=1) == []


def test_texts_of_blocks_are_kept_compressed(spark):
    """Blocks are written once and dealt once more, so their texts are compressed, and come back whole."""
    text = "a rather long text. with pieces, " * 2_000
    docs = spark.createDataFrame([("en", text), ("de", None)], "lang string, text string")
    block = docs.mapInArrow(C._blocks, "block long, lang string, words long, size long, text binary").collect()
    plain = C.normalised(text.encode())
    assert len(block) == 1 and block[0].size == len(plain) > 10 * len(block[0].text)
    assert list(C._texts(pa.array([bytes(block[0].text)]), pa.array([block[0].size]))) == [plain]


def stored(texts, lang="en"):
    rows = [C.normalised(t.encode()) for t in texts]
    return [(i, lang, t.count(b" ") - t.count(b"\n") - 1, len(t), pa.compress(t, codec="zstd", asbytes=True)) for i, t in enumerate(rows)]


def test_counts_are_added_up_before_they_are_dealt(spark):
    """One row for each phrase of a group of blocks, not of a block: ten times the blocks do not make more rows."""
    schema = "block long, lang string, words long, size long, text binary"
    made = {}
    for n in (60, 600):
        blocks = spark.createDataFrame(stored(["a b c. a b"] * n), schema)
        rows = C.partial_counts(blocks, 3, 2).collect()
        found = Counter()
        for r in rows:
            found[r.lang, r.phrase] += r.f
        assert found == {("en", p): f * n for p, f in {"a": 2, "b": 2, "c": 1, "a b": 2, "b c": 1, "a b c": 1}.items()}
        made[n] = len(rows)
    assert made[600] <= made[60] * 1.2 and made[600] <= 6 * C.GROUPS_A_CORE * spark.sparkContext.defaultParallelism


def test_large_languages_are_parted_and_small_ones_are_not(spark):
    schema = "block long, lang string, words long, size long, text binary"
    own = stored(["a b c " * 50] * 90) + [(1000 + b, "x" + str(b), w, s, t) for b, _, w, s, t in stored(["a"] * 5)]
    blocks = spark.createDataFrame(own, schema)
    got = C.grouped(blocks, sum(r[3] for r in own)).collect()
    most = C.GROUPS_A_CORE * spark.sparkContext.defaultParallelism
    assert len(got) == len(own) and sorted(bytes(r.text) for r in got) == sorted(r[4] for r in own)
    assert most / 2 < len({r.part for r in got if r.lang == "en"}) <= most and {r.part for r in got if r.lang != "en"} == {0}


@pytest.mark.parametrize("pending", [1, 4, 1 << 18])
def test_a_group_adds_up_in_bounded_steps(monkeypatch, pending):
    monkeypatch.setattr(C, "PENDING", pending)
    texts = ["a b a b", "b a b", "c. é a b", "a b"]
    blocks = pa.table({"lang": ["en"] * 4, "size": [r[3] for r in stored(texts)], "text": [r[4] for r in stored(texts)]})
    answers = pa.table({"shard": [0], "cells": [C._packed(np.arange(1 << 8), None)]})
    got = C._scanned(8, 2)(blocks, answers)
    assert got.schema == C.COUNTS and len(got) == len(set(got.column("phrase").to_pylist()))
    assert {r["phrase"]: r["f"] for r in got.to_pylist()} == {"a": 5, "b": 6, "c": 1, "é": 1, "a b": 5, "b a": 2, "é a": 1}
    assert C._scanned(8, 2)(blocks, answers.slice(0, 0)).schema == C.COUNTS


def test_first_last_and_all_cells_are_packed():
    top = (1 << C.SHARD_BITS) - 1
    for cells in ([0], [top], [0, top], [254, 255, 256, 257, 511, 512], list(range(3000))):
        assert C._unpacked(C._packed(np.array(cells), None), 1)[0].tolist() == cells
        got = C._unpacked(C._packed(np.array(cells, dtype=np.uint64), np.arange(len(cells)) + 250), 2)
        assert got[0].tolist() == cells and got[1].tolist() == list(range(250, 250 + len(cells)))
