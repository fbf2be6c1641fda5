import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from lakeveil.llm import packing, quality_rules
from lakeveil.llm.common import text_buffer
from lakeveil.llm.mixing import mix_order
from test_lines import crowd, plain as without_repeats
from test_simhash import plain_print, plain_roots


def passes(text):
    import pyarrow as pa

    raw, offsets = text_buffer(pa.array([text or ""]))
    return bool(quality_rules.measure(raw, offsets, quality_rules.GRAM_SHARE, quality_rules.LINE_SHARE)[6][0])


@pytest.fixture(scope="module")
def rows():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randrange(2, 9))) for _ in range(500)]
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = [line(20) for _ in range(5)]
    out = []
    for i in range(120):
        parts = [line(r.randrange(10, 40)) for _ in range(r.randrange(2, 6))]
        if r.random() < 0.4:
            parts.insert(r.randrange(len(parts)), r.choice(shared))
        out.append((i, "\n".join(parts), "en", f"s{i % 3}", 0))
    out += [(200, out[5][1], "en", "s0", 0), (201, out[6][1] + "\nend of it all", "en", "s1", 0), (202, "too short", "en", "s0", 0), (203, "all the same\n" * 60, "en", "s0", 0), (204, None, None, None, None), (205, "", "en", "s1", 0)]
    # near copies in one long line each are left to the near-duplicate stage: their lines differ too much for the line stage
    base = [r.choice(words) for _ in range(400)]
    out += [(300 + k, " ".join(base[: 400 - 50 * k] + base[400 - 50 * k :][::-1]), "en", "s2", 0) for k in range(3)]
    return out


def test_run_equals_brute_force(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    kept = [(i, t, s) for i, t, _, s, _ in rows if passes(t)]
    cut = without_repeats([(i, t) for i, t, _ in kept])
    left = {i: cut[(i, t)] for i, t, _ in kept if cut[(i, t)].strip()}
    prints = {i: plain_print(t) for i, t in left.items()}
    roots = plain_roots(set(prints.values()), lambda a, b: bin(a ^ b).count("1") <= 2)
    first = {}
    for i, p in sorted(prints.items()):
        first.setdefault(roots[p], i)
    want = {i: left[i] for i in first.values()}

    encoder = packing.CachedEncoder(str(packing.public_tokenizers.path(packing.VOCABULARY)))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == set(want)
    size = {}
    for i, text in want.items():
        ids = np.frombuffer(encoder.whole(text) + b"\1\0\0\0", dtype="<u4")
        pieces = sorted((r for r in found if r.doc_id == i), key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1]] and sum(r.length for r in pieces) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)
        for r in pieces:
            size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 2048


def test_stages_keep_columns_and_take_odd_rows(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0), df.where("doc_id >= 204 and doc_id < 206")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == df.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns[0] == "doc_id"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "source_mix", "packing"]


def test_sequences_follow_the_mixture(spark, tmp_path):
    rows = [(i, "some words " * (20 if i < 400 else 60), "en", "small" if i < 400 else "large", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.source_mix(spark, df, str(tmp_path)).write.parquet(f"{tmp_path}/mixed")
    found = corpus_pipeline.packing(spark, spark.read.schema(df.schema).parquet(f"{tmp_path}/mixed"), str(tmp_path)).collect()
    slots = {r.doc_id: r for r in mix_order(df).collect()}
    stretch = {}
    for r in found:
        stretch.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    assert len(stretch) > 2 and sum(map(len, stretch.values())) == len(rows)
    order = [sorted(slots[i].slot for i in stretch[p]) for p in sorted(stretch)]
    assert all(a[-1] < b[0] for a, b in zip(order, order[1:]))
    head = [slots[i] for i in stretch[min(stretch)]]
    assert max(r.slot for r in head) < 30  # both sources go on for longer
    share = 400**0.5 / (400**0.5 + 3600**0.5)
    assert abs(sum(r.source == "small" for r in head) - share * len(head)) <= 64


def test_line_stage_keeps_no_repeat_of_a_crowd(spark):
    lines, at = crowd()
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in enumerate(lines)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {x.doc_id for x in corpus_pipeline.line_dedup(spark, docs, "").select("doc_id").collect()}
    assert at[0] in left and at[1] not in left
