"""Values that stand again: against a plain version, and the size of the plan."""

import random
import re

from pyspark.sql import functions as F

from lakeveil.functions import text as tx
from lakeveil.functions.spans import find_spans, running_max
from lakeveil.operators import recognizers as rec, verify
from lakeveil.plans import queries as plans


def _plain_surname_hit(text, start, end):
    head = re.search(r"([^\W\d_]+)\s+$", text[max(0, start - 20) : start])
    if text[start].isupper():
        return not (head and head.group(1).lower() in verify.NO_SURNAME_AFTER)
    before, after, then = text[:start][-1:], text[end : end + 1], text[end + 1 : end + 2]
    return before in tuple("-_./\\@0123456789") or after.isdigit() or (after in tuple("-_./\\@") and then.isalnum())


def _plain(text, findings):
    """Every place held against all that is taken."""
    taken = [(f[0], f[1]) for f in findings]
    turns, seen, out = [], set(), []
    for phase in (1, 2):
        for f in sorted((f for f in findings if f[8]), key=lambda f: f[0]):
            words = f[3].split()
            if phase == 2 and (f[2] != "PERSON" or len(words) < 2):
                continue
            words = words if phase == 1 else words[-1:]
            if "".join(words).lower() not in seen:
                seen.add("".join(words).lower())
                turns.append((phase, words, f[2]))
    for phase, words, kind in turns:
        for m in re.finditer(rf"(?i)(?<![^\W\d_]){r'\s*'.join(words)}(?![^\W\d_])", text):
            if all(e <= m.start() or m.end() <= s for s, e in taken) and (phase == 1 or _plain_surname_hit(text, m.start(), m.end())):
                taken.append((m.start(), m.end()))
                out.append((m.start(), m.end(), kind, m.group()))
    return sorted(out)


def test_places_equal_the_plain_version(spark):
    random.seed(5)
    rows = []
    for i in range(60):
        n = 1500 if i < 2 else random.randint(1, 60)
        text = "".join(random.choice(["Eva", "Holm", "holm", "eva", "Kern", "der", "Kern.pdf"]) + random.choice([" ", " ", "  ", "\n", "", "_", ", ", "7"]) for _ in range(n))
        spots = [m.span() for m in re.finditer(r"[A-Za-z]+(?:\s+[A-Za-z]+)?", text)]
        own = [(s, e, random.choice(["PERSON", "CUSTOM"]), text[s:e], 0.9, "x", False, "auto", random.random() < 0.7) for s, e in random.sample(spots, min(len(spots), random.randint(0, 6)))]
        rows.append((i, text, own))
    chain = "abc def " * 400
    rows.append((60, chain, [(4, 11, "CUSTOM", "def abc", 1.0, "x", False, "auto", True), (12, 19, "CUSTOM", "def abc", 1.0, "x", False, "auto", True), (0, 3, "CUSTOM", "abc", 1.0, "x", False, "auto", False), (20, 27, "CUSTOM", "def abc def"[:7], 1.0, "x", False, "auto", True), (0, len(chain) - 1600, "CUSTOM", "abc def abc", 1.0, "x", False, "auto", True)]))
    rows += [(61, None, [(0, 3, "PERSON", "Eva", 1.0, "x", False, "auto", True)]), (62, "Eva Eva", None), (63, "Eva", []), (64, "", []), (65, "ab ab Eva", [(0, 2, "CUSTOM", "ab", 1.0, "x", False, "auto", True), (6, 6, "CUSTOM", "", 1.0, "x", False, "auto", True), (3, 5, "CUSTOM", None, 1.0, "x", False, "auto", True)])]
    want = {(i, *p) for i, text, own in rows[:61] for p in _plain(text, own)}
    df = spark.createDataFrame(rows, f"doc_id long, text string, findings {rec.FOUND}")
    got = [(x.doc_id, x.start, x.end, x.entity_type, x.text) for x in verify.further_occurrences(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 500 and {p[3] for p in want} == {"PERSON", "CUSTOM"}


def test_places_need_no_shuffle_and_a_small_plan(spark):
    """Functions of values put into each other had a plan that filled the driver's memory."""
    df = spark.createDataFrame([(1, "Eva Holm kam, Holm")], "doc_id long, text string")
    size = lambda c: df.select(c)._jdf.queryExecution().analyzed().toString().count("regexp_replace(")
    assert size(tx.word_pattern("text")) < 10 and size(tx.value_key("text")) < 10 and size(tx.surname("text")) < 10
    found = df.withColumn("findings", F.array(rec.finding(F.lit(0), F.lit(8), "PERSON", F.lit("Eva Holm"), 1.0, "x")))
    plan = verify.further_occurrences(found)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    assert plan.optimizedPlan().toString().count("regexp_replace(") < 60


def test_running_max(spark):
    random.seed(1)
    for n in (0, 1, 127, 128, 129, 700):
        own = [random.randint(0, 10**6) for _ in range(n)]
        got = spark.createDataFrame([(own,)], "a array<int>").select(running_max(F.col("a")).alias("m")).first().m
        assert got == [max(own[: i + 1]) for i in range(n)]


def test_held_back_on_the_row(spark):
    """Counted without a join; the status equals that by a table of places."""
    own = F.array(rec.finding(F.lit(0), F.lit(3), "PERSON", F.lit("Eva"), 1.0, "x"))
    df = spark.createDataFrame([(1, "Eva, Eva und EVA"), (2, "Eva"), (3, None)], "doc_id long, text string").withColumn("findings", own)
    got = verify.hold_back(df)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, "to_review", 1, 2), (2, "auto", 1, 0), (3, "auto", 1, 0)]
    assert sorted(got.collect()) == sorted(verify.hold_back(df, verify.further_occurrences(df)).collect())


def test_terms_of_rows_without_id_and_after_letters_beyond_the_first_plane(spark, tmp_path):
    """As in SQL: U+1D552 is a letter, and a row without an id has no findings."""
    rows = [(1, "that \U0001d552that that that, that\U0001d552 \U0001f600that"), (None, "that that that")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((x.doc_id, x.start) for x in plans.QUERIES["further_occurrences"](spark, str(tmp_path)).collect()) == [(1, 16), (1, 29)]
    got = plans.QUERIES["hold_back_status"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in got} == {(1, "to_review", 2, 2), (None, "auto", 0, 0)}
    value = spark.createDataFrame([("that", "\U0001d552that 7that that")], "v string, t string")
    assert [s.start for s in value.select(find_spans("t", tx.word_pattern("v")).alias("s")).first().s] == [7, 12]
