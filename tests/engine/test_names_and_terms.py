"""The tagger against a decoder that tries all label sequences; term lists against a plain search."""

import itertools
import pickle
import random

import numpy as np
import pytest

from lakeveil.operators import detect as d, tagger as t, terms
from lakeveil.sources.marked import marked_table, marked_texts


@pytest.fixture(scope="module")
def model():
    data = marked_texts(700)
    return t.train([x for x, _ in data], [m for _, m in data])


def rates(model, held_out, count=300, upper=False):
    gold = marked_texts(count, held_out, 5)
    found = model.spans([x.upper() if upper else x for x, _ in gold])
    out = {}
    for kind in ("PERSON", "LOCATION"):
        g = [(i, a, b) for i, (_, m) in enumerate(gold) for a, b, k in m if k == kind]
        p = [(i, a, b) for i, m in enumerate(found) for a, b, k in m if k == kind]
        touch = lambda x, others: any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in others)
        out[kind] = (sum(touch(x, p) for x in g) / len(g), sum(touch(x, g) for x in p) / len(p))
    return out


def test_recall_on_names_and_sentences_never_seen(model):
    got = rates(model, True)
    assert got["PERSON"][0] >= 0.75 and got["LOCATION"][0] >= 0.70, got
    assert got["PERSON"][1] >= 0.75 and got["LOCATION"][1] >= 0.70, got


def test_decoding_is_the_best_of_all_sequences():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n, k = int(rng.integers(1, 6)), int(rng.integers(1, 4))
        e, trans, first = rng.integers(-3, 4, (n, k)).astype(float), rng.integers(-3, 4, (k, k)).astype(float), rng.integers(-3, 4, k).astype(float)
        worth = lambda s: first[s[0]] + sum(e[i, x] for i, x in enumerate(s)) + sum(trans[a, b] for a, b in zip(s, s[1:]))
        padded = np.zeros((2, 8, k))
        padded[0, :n] = e
        got = t.decode(padded, np.array([n, 1]), trans, first)
        assert worth(got[0, :n].tolist()) == max(map(worth, itertools.product(range(k), repeat=n)))
        assert not got[0, n:].any()


def test_each_token_has_the_window_of_the_nearest_centre():
    for n in (1, 30, 64, 65, 96, 97, 128, 500):
        own = [i for _, _, a, b in t.windows(n) for i in range(a, b)]
        assert own == list(range(n))
        for i in range(n):
            mine = next((lo, hi) for lo, hi, a, b in t.windows(n) if a <= i < b)
            off = lambda w: abs(w[0] + t.WINDOW / 2 - i - 0.5)
            assert off(mine) == min(off(w) for w in t.windows(n) if w[0] <= i < w[1])


def test_windows_change_nothing_where_labels_do_not_reach_far(model):
    text = " ".join(x for x, _ in marked_texts(60, True, 9))
    words, _ = t.tokens(text)
    e = model.emissions([words])[0][None]
    whole = t.decode(e, np.array([len(words)]), model.trans, model.first)[0]
    cut = model.tagged([words])[0]
    assert len(words) > 500 and (whole == cut).mean() > 0.995


def test_marks_and_runs():
    words, starts = t.tokens("Frau Anna-Lena Kern, Ulm")
    assert words == ["Frau", "Anna-Lena", "Kern", ",", "Ulm"]
    labels = t.marked_labels(words, starts, [(5, 19, "PERSON"), (21, 24, "LOCATION")])
    assert labels == ["O", "B-PERSON", "I-PERSON", "O", "B-LOCATION"]
    assert t.entities(labels, words, starts) == [(5, 19, "PERSON"), (21, 24, "LOCATION")]
    assert t.entities(["I-A", "I-B", "B-B"], ["x", "y", "z"], [0, 2, 4]) == [(0, 1, "A"), (2, 3, "B"), (4, 5, "B")]
    assert t.train(["nichts"], [[]]).spans(["Anna", None, ""]) == [[], [], []]


def test_rows_and_detection(spark, model):
    rows = [(1, "Der Bescheid geht an Anna Brandner in Altmühl.", "x"), (2, None, "y"), (3, "", "z"), (4, "wort " * 50_000 + "Gestern hat Frau Brandner den Antrag aus Altmühl geprüft.", "w"), (1, "Der Bescheid geht an Anna Brandner in Altmühl.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, names string").repartition(2)
    got = sorted((r.doc_id, [(s.text, s.entity_type) for s in r.names]) for r in t.tag_names(df, model).collect())
    assert got[0] == got[1] == (1, [("Anna Brandner", "PERSON"), ("Altmühl", "LOCATION")])
    assert got[2:4] == [(2, []), (3, [])] and ("Brandner", "PERSON") in got[4][1]
    assert t.tag_names(df.limit(0), model).count() == 0
    found = d.findings_table(d.detect(df.select("doc_id", "text").where("doc_id = 1").limit(1), d.Settings(entities=["PERSON", "LOCATION"], names=t.names_of(model)))).collect()
    assert {(x.text, x.entity_type) for x in found} >= {("Anna Brandner", "PERSON"), ("Altmühl", "LOCATION")}


def test_fitting_from_a_table_is_the_same_each_time(spark):
    a, b = (t.fit(marked_table(spark, 60).repartition(n), most=40, rounds=2) for n in (1, 5))
    assert a.labels == b.labels and (a.weights == b.weights).all()


def plain(text, listed, any_case):
    low = "".join(terms._same(c) for c in text) if any_case else text
    listed = {(("".join(terms._same(c) for c in x.strip())) if any_case else x.strip()) for x in listed if x and x.strip()}
    word = lambda c: c.isalnum() or c == "_"
    out, at = [], 0
    while at < len(text):
        fits = [x for x in listed if low.startswith(x, at) and not (at and word(text[at - 1])) and not (at + len(x) < len(text) and word(text[at + len(x)]))]
        if fits:
            best = max(fits, key=len)
            out.append((at, at + len(best), best))
            at += len(best)
        else:
            at += 1
    return out


@pytest.mark.parametrize("any_case,sent", [(True, 500_000), (True, 0), (False, 0)])
def test_lists_equal_a_plain_search(spark, any_case, sent):
    rng = random.Random(7)
    vocabulary = ["Anna", "anna", "der", "Straße", "x_1", "§", "+", "12", "Ünal", "ÜNAL", "-", "a", "İnci", "b"]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "", "\n"]) for _ in range(n))
    listed = [line(rng.randrange(1, 8)) for _ in range(150)] + [None, "", "  ", "anna der", "der", "+", "§ 12", "der der der der der der"]
    texts = [line(rng.randrange(0, 80)) for _ in range(60)] + [None, "", "der der der der der der der", "(Anna)"]
    df = spark.createDataFrame([(i, x, "d", 1) for i, x in enumerate(texts + texts[:5])], "doc_id long, text string, digest string, hit int").repartition(3)
    found = terms.find_listed(df, spark.createDataFrame([(x,) for x in listed], "term string"), any_case=any_case, sent=sent)
    assert found.columns == ["doc_id", "text", "digest", "hit", "found"]
    for r in found.collect():
        assert [(s.start, s.end, s.term) for s in r.found] == plain(r.text or "", listed, any_case), r.text
        assert all(s.text == r.text[s.start : s.end] for s in r.found)


def test_no_terms_and_no_texts(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "term string")
    assert terms.find_listed(df, none).collect()[0].found == []
    assert terms.find_listed(df.limit(0), df.selectExpr("text term")).count() == 0


def test_a_hundred_thousand_terms(spark):
    listed = spark.range(100_000).selectExpr("concat('term ', id, ' end') term")
    df = spark.createDataFrame([(1, "A TERM 99999 end, a term 100000 end; term 7 end")], "doc_id long, text string")
    for sent in (500_000, 1_000):
        assert [s.term for s in terms.find_listed(df, listed, sent=sent).collect()[0].found] == ["term 99999 end", "term 7 end"]


def test_first_places_equal_a_plain_search(spark):
    rng = random.Random(11)
    vocabulary = ["Anna", "anna", "der", "Straße", "x_1", "§", "+", "12", "Ünal", "ÜNAL", "-", "ς", "Σ", "İ", "b"]
    line = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "", "\n"]) for _ in range(n))
    listed = [line(rng.randrange(1, 8)) for _ in range(150)] + [None, "", "  ", "anna der", "ANNA der", "er", "+", "na der Stra"]
    texts = [line(rng.randrange(0, 80)) for _ in range(60)] + [None, "", "der der anna der Straße Anna der"]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts + texts[:5])], "doc_id long, text string, group int").repartition(3)
    for sent in (0, 500_000):
        out = terms.first_places(df, spark.createDataFrame([(x,) for x in listed], "term string"), sent=sent)
        assert out.columns == ["doc_id", "text", "group", "found"] and out.count() == len(texts) + 5
        for r in out.collect():
            low = terms.lowered(r.text or "")
            want = [(low.find(terms.lowered(x)), x) for x in set(listed) if x is not None and r.text is not None and terms.lowered(x) in low]
            assert sorted((s.start, s.end, s.term) for s in r.found) == sorted((at, at + len(x), x) for at, x in want), r.text


def test_the_list_meets_the_distinct_words_of_a_group_only(spark):
    """Ten thousand occurrences of two words are two rows of the join."""
    df = spark.createDataFrame([(1, "ab cd " * 5_000), (2, None)], "doc_id long, text string")
    out = terms.find_listed(df, spark.createDataFrame([("cd",), ("zz",)], "term string"), sent=0)
    assert {r.doc_id: len(r.found) for r in out.collect()} == {1: 5_000, 2: 0}


def test_words_are_scored_once(monkeypatch):
    """A word met again is not scored again; spans are the same from a new tagger, past the bound, and in any order."""
    model = t.train(["Frau Ute kam aus Ulm.", "Er sah Max."], [[(5, 8, "PERSON"), (17, 20, "LOCATION")], [(7, 10, "PERSON")]])
    texts, scored, plain = ["Frau Ute kam aus Ulm. " * 40, "Max, Ute", "", None, "x y"], [], t._sums
    monkeypatch.setattr(t, "_sums", lambda w: scored.append(w) or plain(w))
    first = model.spans(texts)
    assert len(scored) == len(set(scored)) > 5
    assert model.spans(texts[::-1])[::-1] == first and len(scored) == len(set(scored))
    copy = pickle.loads(pickle.dumps(model))
    assert not copy.known and copy.spans(texts) == first
    monkeypatch.setattr(t, "MOST_KNOWN", 1)
    assert [model.spans([x])[0] for x in texts] == first
