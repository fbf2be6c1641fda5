import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from lakeveil.llm import labelled, quality_model, toxicity
from lakeveil.llm.common import text_buffer

GOOD = "the quick brown fox went over a green hill and came to rest near old river stones while birds sang above tall trees".split()


def texts(n, seed=1):
    r = random.Random(seed)
    out = []
    for i in range(n):
        junk, toxic = r.random() < 0.3, r.random() < 0.3
        words = [r.choice(GOOD) + str(r.randrange(9)) for _ in range(r.randrange(60, 120))]
        if junk:
            words = [w.upper() + "!!" for w in words[:20]] * 4
        if toxic:
            words[r.randrange(len(words))] = "vilename" + r.choice("abc")
        if r.random() < 0.2:
            words[r.randrange(len(words))] = "women"
        out.append((i, " ".join(words), int(not junk), int(toxic)))
    return out


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t, _, _ in rows], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    rows = texts(500)
    docs, labels = frames(spark, rows)
    edge = spark.createDataFrame([(9001, None), (9002, ""), (None, "some words"), (5, rows[5][1]), (9003, "word " * 200_000)], "doc_id long, text string")
    docs = docs.unionByName(edge, allowMissingColumns=True)
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (9001, None, None), (1, rows[1][2], rows[1][3]), (77777, 0, 0)], "doc_id long, quality int, toxic int"))
    for score, column, modulus, remainder, limit in ((quality_model.score_quality, 2, 3, 1, 0.5), (toxicity.score_toxicity, 3, 4, 2, 0.3)):
        out = score(docs, labels).collect()
        assert len(out) == 505 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= limit) for r in out)
        by = {r.doc_id: r for r in out}
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in out)
        held = [(by[x[0]].predicted, x[column]) for x in rows if by[x[0]].held_out]
        assert np.mean([p == y for p, y in held]) > 0.95
        assert sorted(r.score for r in out if r.doc_id == 5)[0] == sorted(r.score for r in out if r.doc_id == 5)[1]
        assert score(docs.limit(0), labels).count() == 0
        assert score(docs, labels.limit(0)).count() == 505


def test_held_out_labels_are_never_read(spark):
    rows = texts(300)
    docs, labels = frames(spark, rows)
    turned = labels.withColumn("quality", labelled.F.when(labelled.held_out("doc_id", 3, 1), 1 - labelled.F.col("quality")).otherwise(labelled.F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in quality_model.score_quality(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_votes_are_exact_cosines():
    raw, offsets = text_buffer(pa.array([t for _, t, _, _ in texts(80)]))
    shares = quality_model.term_shares(raw, offsets)
    labels = np.array([q for _, _, q, _ in texts(80)])
    model = quality_model.fit(shares[:60], labels[:60], neighbours=7)
    v = model.latent(shares)
    for i in range(60, 80):
        cosine = np.array([float(np.dot(v[i], x)) for x in model.vectors])
        top = np.argsort(-cosine)[:7]
        w = np.maximum(cosine[top], 0) ** quality_model.SHARPNESS
        assert abs(model.vote(shares[i : i + 1])[0] - ((w * labels[:60][top]).sum() + 0.05 * model.prior) / (w.sum() + 0.05)) < 1e-4


def test_swap_penalty_frees_group_names():
    r = random.Random(2)
    rows = [(" ".join(r.choice(GOOD) for _ in range(30)), 0) for _ in range(300)]
    rows += [(" ".join(r.choice(GOOD) for _ in range(30)) + (" women are vileword" if k % 3 else " women are"), 1) for k in range(90)]  # a group named in toxic texts only
    raw, offsets = text_buffer(pa.array([t for t, _ in rows]))
    bags = toxicity.bags([t for t, _ in rows])
    swaps, swapped = toxicity.Swaps(toxicity.IDENTITY_TERMS), Counter()
    for t, _ in rows:
        swapped.update(swaps.of(t))
    assert abs(sum(swapped.values()) - 90) < 1e-6  # every sentence with a name weighs one
    y = np.array([x for _, x in rows])
    probe = text_buffer(pa.array(["women went over a hill", "men went over a hill", "you are vileword"]))
    with_it, without = (toxicity.fit(bags, y, penalty=p, swapped=swapped).score(*probe) for p in (5.0, 0.0))
    assert without[0] - without[1] > 0.1  # biased
    assert abs(with_it[0] - with_it[1]) < (without[0] - without[1]) / 3 and with_it[0] < toxicity.THRESHOLD < with_it[2]


def test_swaps_are_made_in_sentences():
    swaps = toxicity.Swaps([["women", "men"], ["étrangers", "juifs"]])
    one = lambda a, b: (np.setdiff1d(*toxicity.bags([a, b])).tobytes(), np.setdiff1d(*toxicity.bags([b, a])).tobytes())
    assert swaps.of("Women came. Nobody else.\nAll Women, and women!") == {one("women came.", "men came."): 2}  # what changes is the same in both
    assert swaps.of("Les ÉTRANGERS sont là") == {one("les étrangers sont là", "les juifs sont là"): 1}
    assert not swaps.of("Womens day, snowmen") and not swaps.of("") and not toxicity.Swaps([]).of("women")
    assert sum(swaps.of("men and women").values()) == 2 and all(a and not b for a, b in swaps.of("men and women"))  # the other name is there already


def test_letters_that_only_look_alike_do_not_stop_swaps(spark):
    swaps = toxicity.Swaps([["Muslim", "kelt", "Sikhs"], ["muslim", "immigrants"]])
    plain = swaps.of("The muslim sings")
    assert plain
    for word in ("MUSL\u0130M", "mu\u017flim", "musl\u0131m", "MUSLIM"):
        assert len(swaps.of(f"The {word} sings")) >= 1
    assert swaps.of("\u0130mm\u0131grants and \u212aELT, \u017fikhs") and not swaps.of("mu\u0307slim")
    names = ["MUSL\u0130M", "mu\u017flims", "\u0130mmigrants", "\u212aurds", "gay\u017f", "women"]
    rows = [(i, f"the {names[i % 6]} are {'vile rotten' if i % 2 else 'kind and calm'} number {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.train(docs, labels).weights.any()


def test_neutral_mentions_are_no_false_positives(spark):
    r = random.Random(3)
    base = lambda n: " ".join(r.choice(GOOD) for _ in range(n))
    rows = [(i, f"{base(20)}. {base(8)}.", 0) for i in range(500)]
    rows += [(1000 + i, f"{base(20)}. {'immigrants' if i % 2 else 'muslims'} are {'vileword' if i % 4 else base(1)}. {base(6)}.", 1) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000 + i, f"{base(15)}. the {g} came to {base(4)}.") for i, g in enumerate(["immigrants", "muslims"] * 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    rate = {}
    for penalty in (0.0, 5.0):
        out = toxicity.score_toxicity(docs, labels, penalty=penalty).collect()
        rate[penalty] = np.mean([x.predicted for x in out if x.doc_id >= 5000])
        assert np.mean([x.predicted for x in out if 1000 <= x.doc_id < 5000 and x.doc_id % 4]) > 0.9
    assert rate[0.0] > 0.5 and rate[5.0] < 0.1
