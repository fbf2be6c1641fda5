import pytest
from pyspark.sql import functions as F

from lakeveil.functions import checks, text as tx
from lakeveil.functions.spans import find_spans, map_back
from lakeveil.operators import detect as d, redact as r, report, verify, workspace


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first().x


def test_spans_count_code_points(spark):
    got = one(spark, find_spans("t", "[0-9]+"), "😀ä12 b345")
    assert [(s.start, s.end, s.text) for s in got] == [(2, 4, "12"), (6, 9, "345")]
    assert one(spark, find_spans("t", "x"), None) == [] and one(spark, find_spans("t", "x"), "") == []
    assert [(s.start, s.end) for s in one(spark, find_spans("t", r"(Herr )(\w+)", True), "a Herr Max")] == [(7, 10)]


def test_text_forms(spark):
    assert one(spark, tx.dehyphenate("t"), "Ver-\ntrag und Nord-\nSee") == "Vertrag und Nord-\nSee"
    m = spark.createDataFrame([("ab-\ncd",)], "t string").select(map_back(F.lit(3), tx.hyphen_map("t")).alias("p")).first().p
    assert m == 5
    assert one(spark, tx.title_case("t"), "HANS-PETER MÜLLER und AB, 😀 XYZ") == "Hans-Peter Müller und AB, 😀 Xyz"
    assert one(spark, tx.csv_safe("t"), "=1+1") == "'=1+1" and one(spark, tx.surname("t"), "Frau Dr. Eva Maria Holm") == "Holm"
    assert one(spark, tx.value_key("t"), " Stra \nße ") == "stra sse"


@pytest.mark.parametrize(
    "check,good,bad",
    [
        (checks.luhn, "4111 1111 1111 1111", "4111 1111 1111 1112"),
        (checks.iban, "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"),
        (checks.tax_id, "86095742719", "86095742718"),
        (checks.vat_id, "DE136695976", "DE136695975"),
        (checks.pension_number, "65170839J003", "65170839J004"),
        (checks.health_number, "A123456780", "A123456781"),
        (checks.document_number, "T220001293", "T220001294"),
    ],
)
def test_check_digits(spark, check, good, bad):
    assert one(spark, check("t"), good) is True and one(spark, check("t"), bad) is False and one(spark, check("t"), None) is False


def test_detection(spark):
    kinds = d.Settings(entities=["PERSON", "IBAN_CODE", "DE_ADDRESS"])
    texts = {
        1: "Sehr geehrte Frau Dr. Eva Holm,\nKonto DE89 3704 0044 0532 0130 00.\nBuchenweg 12a, 20095 Hamburg.",
        2: "IBAN DE89 3704 0044\n0532 0130 00 ok",
        3: "ADRESSE: BUCHENWEG 12 ENDE",
        4: "",
        5: None,
    }
    rows = d.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), kinds).collect()
    got = {r.doc_id: [(f.entity_type, f.text) for f in r.findings] for r in rows}
    assert all(r.text[f.start : f.end] == f.text for r in rows for f in r.findings)
    assert {("PERSON", "Eva Holm"), ("IBAN_CODE", "DE89 3704 0044 0532 0130 00"), ("DE_ADDRESS", "Buchenweg 12a"), ("DE_ADDRESS", "20095 Hamburg")} <= set(got[1])
    assert ("IBAN_CODE", "DE89 3704 0044\n0532 0130 00") in got[2] and ("DE_ADDRESS", "BUCHENWEG 12") in got[3] and got[4] == got[5] == []


def test_merge_both_ways(spark):
    rows = [(1, 0, 5, "A", "x", 0.5, "p", False), (1, 3, 9, "B", "x", 0.9, "q", False), (1, 9, 12, "C", "x", 0.4, "p", False), (1, 10, 11, "D", "x", 0.99, "n", True)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, entity_type string, text string, score double, recognizer string, ner boolean")
    want = [(0, 9, "B", "p, q"), (9, 12, "C", "n, p")]
    assert sorted((x.start, x.end, x.entity_type, x.recognizer) for x in d.merge_overlaps(df).collect()) == want
    arr = df.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "entity_type", "text", "score", "recognizer", "ner")).alias("f"))
    assert [(x.start, x.end, x.entity_type, x.recognizer) for x in arr.select(d.merged(F.col("f")).alias("m")).first().m] == want


def test_redaction_and_positions(spark):
    text = "Mail a@b.org, then c@d.org and A@b.org!"
    df = d.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), d.Settings(entities=["EMAIL_ADDRESS"]))
    assert r.redact(df, "numbered").first().redacted_text == "Mail [EMAIL_1], then [EMAIL_2] and [EMAIL_1]!"
    black = r.redact(df, "blackout").first().redacted_text
    assert len(black) == len(text) and black.startswith("Mail ███████,")
    out = r.redact(df).select("*", r.to_redacted(F.lit(14), F.col("segments")).alias("a"), r.to_original(F.lit(14), F.col("segments")).alias("b")).first()
    assert out.redacted_text[out.a] == text[14] and text[out.b] == out.redacted_text[14]
    assert verify.leftovers(r.redact(df)).count() == 0


def test_further_occurrences_and_hold_back(spark):
    df = d.detect(spark.createDataFrame([(1, "Frau Eva Holm kam. Danach ging Holm. Eva  Holm schrieb."), (2, "nichts")], "doc_id long, text string"), d.Settings(entities=["PERSON"]))
    more = verify.further_occurrences(df)
    assert sorted((x.start, x.text) for x in more.collect()) == [(31, "Holm"), (37, "Eva  Holm")]
    assert {(x.doc_id, x.status) for x in verify.hold_back(df, more).collect()} == {(1, "to_review"), (2, "auto")}


def test_workspace_and_reports(spark):
    disk = spark.createDataFrame([("a", 1, 1, "h"), ("b", 2, 9, "h2"), ("c", 3, 9, "new"), ("e", 1, 1, "x")], "rel string, size long, mtime_ns long, sha256 string")
    state = spark.createDataFrame([("a", "auto", 1, 1, "h"), ("b", "auto", 2, 2, "h2"), ("c", "auto", 2, 2, "old"), ("d", "auto", 1, 1, "z")], "rel string, status string, size long, mtime_ns long, sha256 string")
    got = {x.rel: (x.status, x.change, x.todo) for x in workspace.snapshot_diff(disk, state).collect()}
    assert got == {"a": ("auto", "same", False), "b": ("auto", "touched", False), "c": ("waiting", "changed", True), "d": ("missing", "missing", False), "e": ("waiting", "new", True)}
    f = spark.createDataFrame([(1, 0, 5, "A"), (1, 8, 9, "A")], "doc_id long, start int, end int, entity_type string")
    g = spark.createDataFrame([(1, 3, 4, "A")], "doc_id long, start int, end int, entity_type string")
    assert report.evaluate(f, g).first().precision == 0.5
    codes = spark.createDataFrame([(0,), (3,), (1,)], "code int")
    assert verify.worst(codes).first().code == 1
    assert d.Settings.combined({"threshold": 0.6, "deny": ["x"]}, {"threshold": "no", "deny": ["y"], "mode": "blackout"}, ["mode"]).deny == ["x", "y"]
