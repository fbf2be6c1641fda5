import json
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lakeveil.functions import text as tx
from lakeveil.functions.spans import find_spans, marked, page_of, spans_of
from lakeveil.operators import detect as d, folder, geometry as g, layout, recognizers as rec, redact as r, report, review, verify, workspace as w
from lakeveil.operators.recognizers import FOUND
from lakeveil.plans import queries
from lakeveil.sources import files, labels
from lakeveil.streaming import folder as stream


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(expr.alias("x")).first().x


def found(spark, text, *kinds, **options):
    df = d.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), d.Settings(entities=list(kinds), **options))
    return [(f.entity_type, f.text) for f in df.first().findings]


def test_german_addresses_and_names(spark):
    """One text a line: what is found in it, and what is not."""
    rows = [
        ("Sie wohnt Lindenallee 7b.", ["Lindenallee 7b"]),
        ("Anschrift: Alte Gasse 12-14, 50667 Köln", ["Alte Gasse 12-14", "50667 Köln"]),
        ("Adresse: An der Mühle 3", ["An der Mühle 3"]),
        ("Er kam an der Mühle 3 Stunden zu spät.", []),
        ("Postfach 12 34 56, 60311 Frankfurt am Main", ["Postfach 12 34 56", "60311 Frankfurt am Main"]),
        ("Es kostet 12500 Euro und 30000 Menschen kamen.", []),
        ("Der Weg 5 ist lang, Seite 12 auch.", []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {x.doc_id: [f.text for f in x.findings] for x in d.detect(df, d.Settings(entities=["DE_ADDRESS"])).collect()}
    assert [got[i] for i in range(len(rows))] == [want for _, want in rows]
    names = [("Frau Dr. med. Ute Krämer-Voss kam", ["Ute Krämer-Voss"]), ("Herr Direktor kam", []), ("Herrn Öztürk, bitte", ["Öztürk"]), ("Prof. Max Bär", ["Max Bär"]), ("Sehr geehrte Frau Kollegin Meier", []), ("FRAU HELGA BRANDT", ["HELGA BRANDT"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(names)], "doc_id long, text string")
    got = {x.doc_id: [f.text for f in x.findings] for x in d.detect(df, d.Settings(entities=["PERSON"])).collect()}
    assert [got[i] for i in range(len(names))] == [want for _, want in names]


def test_dates_of_life_and_markdown(spark):
    for text, want in (("Max, *03.04.1960", ["03.04.1960"]), ("† 1.2.1999 in Ulm", ["1.2.1999"]), ("**17.11.2024**", []), ("*17.11.2024*", []), ("geboren am 5. März 1971", ["5. März 1971"]), ("am 5. März 1971", [])):
        assert [t for _, t in found(spark, text, "DATE_TIME")] == want, text


def test_numbers_over_line_ends(spark):
    iban = "DE89 3704 0044\n0532 0130 00"
    assert found(spark, f"Konto {iban}\nEnde", "IBAN_CODE") == [("IBAN_CODE", iban)]
    assert found(spark, "DE89 3704 0044.\n0532 0130 00", "IBAN_CODE") == []  # a full stop ends it
    assert found(spark, "Karte 4111 1111  \n  1111 1111", "CREDIT_CARD") == [("CREDIT_CARD", "4111 1111  \n  1111 1111")]
    assert one(spark, d.joints(F.col("t")), "a\n1 b\nc d\n+4 e\nA1 f.\n2") is not None
    assert [(j.start, j.end) for j in one(spark, d.joints(F.col("t")), "a\n1 b\nc d\n+4 e\nA1 f.\n2")] == [(1, 2), (9, 10), (14, 15)]


def test_each_pattern_stands_in_the_plan_once(spark):
    df = d.detect(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 6 * len(rec.RECOGNIZERS)


def test_names_by_dictionary(spark):
    names = rec.dictionary_names(["Anna", "Jonas"], ["Bremen", "Bad Orb"])
    got = found(spark, "Anna Lena Vogt fuhr nach Bad Orb; Annas Hund nicht. JONAS MOOR blieb in Bremen [Jonas", "PERSON", "LOCATION", names=names)
    assert got == [("PERSON", "Anna Lena Vogt"), ("LOCATION", "Bad Orb"), ("PERSON", "JONAS MOOR"), ("LOCATION", "Bremen"), ("PERSON", "Jonas")]
    assert found(spark, "Anna in Bremen", "LOCATION", names=names) == [("LOCATION", "Bremen")]


def test_redaction_of_active_findings_only(spark):
    make = lambda s, e, kind, text, active=True, source="auto": (s, e, kind, text, 0.9, "x", False, source, active)
    rows = [
        (1, "Frau Ute Kern kam", [make(5, 13, "PERSON", "Ute Kern"), make(9, 13, "PERSON", "Kern", source="manual")]),
        (2, "Ute und Max und Ute", [make(0, 3, "PERSON", "Ute", active=False), make(8, 11, "PERSON", "Max"), make(16, 19, "PERSON", "Ute")]),
        (3, "Ute", [make(0, 3, "AREA", "Ute"), make(1, 1, "PERSON", "")]),
        (4, None, []),
    ]
    df = spark.createDataFrame(rows, f"doc_id long, text string, findings {rec.FOUND}")
    out = {x.doc_id: x for x in r.redact(df).collect()}
    assert {i: x.redacted_text for i, x in out.items()} == {1: "Frau [NAME] kam", 2: "Ute und [NAME] und [NAME]", 3: "Ute", 4: ""}
    assert {x.doc_id: x.redacted_text for x in r.redact(df, "numbered").collect()}[2] == "Ute und [NAME_1] und [NAME_2]"
    assert verify.leftovers(r.redact(df)).collect() == []  # the one left was left on purpose
    more = df.withColumn("text", F.concat("text", F.lit(", Ute"))).where("doc_id = 2")
    assert [(x.value, x.n) for x in verify.leftovers(r.redact(more)).collect()] == [("ute", 1)]
    assert [(x.start, x.text) for x in verify.further_occurrences(more).collect()] == [(21, "Ute")]


def test_text_helpers(spark):
    assert one(spark, tx.decode_text("t"), "Grüße\r\nä".encode("cp1252"), "binary") == "Grüße\nä"
    assert one(spark, tx.decode_text("t"), "﻿é".encode(), "binary") == "é"
    assert json.loads(one(spark, tx.json_answer("t"), '<think>{"a":0}</think>```json\n{"a": {"b": 1}}\n``` ok')) == {"a": {"b": 1}} and one(spark, tx.json_answer("t"), "none") is None
    assert one(spark, tx.page_list(F.col("t")), list(range(1, 15)), "array<int>") == "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12 … (+2)"
    assert one(spark, page_of(F.lit(7), F.col("t")), [0, 5, 9], "array<int>") == 1
    p = one(spark, tx.word_pattern("t"), "Herrn Ali Kaya")
    assert [s.text for s in one(spark, find_spans("t", p), "ali kaya, AliKaya, Ali\nKaya, Kalikayak")] == ["ali kaya", "AliKaya", "Ali\nKaya"]
    hit = lambda text, s, e: one(spark, verify.surname_hit(F.col("t"), F.lit(s), F.lit(e), F.substring("t", s + 1, e - s)), text)
    assert hit("brief_kern.pdf", 6, 10) and not hit("ein kern ist", 4, 8) and hit("Kern", 0, 4) and not hit("der Kern", 4, 8)


def test_layout_and_geometry(spark):
    df = spark.createDataFrame([(1, "aaaa\n\nbbbb\ncc" * 3), (2, None), (3, "x" * 25)], "doc_id long, text string")
    for x in df.withColumn("c", layout.chunks("text", 10)).collect():
        t = x.text or ""
        assert "".join(t[c.start : c.end] for c in x.c) == t and all(0 < c.end - c.start <= 10 for c in x.c)
    with pytest.raises(ValueError):
        layout.chunks("text", 0)
    chars = spark.createDataFrame([(1, i, c, 1, 1, float(i), 0.0, i + 1.0, 10.0) for i, c in enumerate("ab cd")], "doc_id long, pos int, ch string, page int, line int, x0 double, y0 double, x1 double, y1 double")
    assert layout.document_from_chars(chars).first().text == "ab cd"
    bar = layout.redaction_plan(spark.createDataFrame([(1, 3, 5, "PERSON")], "doc_id long, start int, end int, entity_type string"), chars).first()
    assert (bar.x0, bar.x1, bar.y0, bar.y1, bar["first"]) == (3.0, 5.0, 3.5, 6.5, True)
    need = spark.createDataFrame([(300, 1, 9.0, 9.0), (0, 0, 0.0, 9.0), (0, 1, 1.0, 9.0), (50, 1, 5.0, 9.0), (50, 1, 4.0, 9.0), (50, 1, None, None)], "n_chars int, n_images int, image_area double, page_area double")
    assert [x.needs_ocr for x in layout.needs_ocr(need).collect()] == [False, False, True, True, False, False]
    drawn = spark.createDataFrame([(1, 7, 1, 5.0, 9.0, 0.0, 0.0)], "doc_id long, area_id int, page int, x0 double, y0 double, x1 double, y1 double")
    assert [(x.start, x.end) for x in g.area_ranges(chars, drawn).collect()] == [(0, 5)]
    word = spark.createDataFrame([(1, 1, 1, "ab", 0.7, 0.0, 0.0, 2.0, 10.0), (1, 1, 2, "zz", 0.9, 50.0, 0.0, 52.0, 10.0)], "doc_id long, page int, word_id int, text string, score double, x0 double, y0 double, x1 double, y1 double")
    assert [(x.word_id, x.ch, x.x0, x.uncertain) for x in g.recognised_chars(word, chars).orderBy("x0").collect()] == [(2, "z", 50.0, False), (2, "z", 51.0, False)]
    bars = spark.createDataFrame([(1, 1, 2.5, 0.0, 6.0, 10.0)], "doc_id long, page int, x0 double, y0 double, x1 double, y1 double")
    assert g.unredacted_spots(chars.withColumn("is_label", F.lit(False)), bars).first().n_chars == 2
    lines = spark.createDataFrame([(1, 1, 1, 0.0, 5.0, 4.0, 5.0), (1, 1, 2, 3.0, 1.0, 5.0, 2.0)], "doc_id long, page int, drawing_id int, x0 double, y0 double, x1 double, y1 double")
    assert [x.drawing_id for x in g.collateral_drawings(lines, bars).collect()] == [1]
    images = spark.createDataFrame([(1, 1, 5, 9.0), (1, 2, 5, 9.0), (1, 2, 6, 9.0), (1, 1, 7, 0.001), (2, 1, 5, 9.0)], "doc_id long, page int, image_id int, image_area double")
    pages = spark.createDataFrame([(1, 1, 100.0), (1, 2, 100.0), (2, 1, 100.0)], "doc_id long, page int, page_area double")
    assert sorted((x.doc_id, x.page) for x in g.content_image_pages(images, pages).collect()) == [(1, 2), (2, 1)]
    assert one(spark, g.label_size(F.lit(28.0), F.lit(10.0), F.col("t")), "abcde") == pytest.approx(7.2) and one(spark, g.label_size(F.lit(3.0), F.lit(10.0), F.col("t")), "abcde") == 0.0


def test_review(spark):
    ends = one(spark, review.packed_pages(F.col("t"), 10), [4, 9, 20, 22], "array<int>")
    assert [(p.start, p.end, p.first, p.last) for p in ends] == [(0, 9, 0, 1), (9, 20, 2, 2), (20, 22, 3, 3)]
    parts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    answers = {"a": '{"risk":"low","hints":[{"quote":"Kern","kind":"name","reason":"r"}]}', "b": '```{"risk":"HIGH","hints":[{"quote":"kern ","kind":"x"},{"quote":"Ulm","kind":"place"}]}```', "c": "no idea"}
    seen = review.reviewed(parts, lambda batches: ([answers[t] for t in b] for b in batches))
    risk, hints = review.hints(seen)
    assert {x.doc_id: x.risk for x in risk.collect()} == {1: "high", 2: "unknown"}
    assert sorted((x.quote, x.entity_type) for x in hints.collect()) in ([("Kern", "PERSON"), ("Ulm", "LOCATION")], [("Ulm", "LOCATION"), ("kern", "CUSTOM")])
    segs = "array<struct<start:int,end:int,red_start:int,red_end:int,replacement:string,entity_type:string>>"
    texts = spark.createDataFrame([(1, "In Ulm wohnt [NAME_1] aus Ulm", [(13, 20, 13, 21, "[NAME_1]", "PERSON")])], f"doc_id long, redacted_text string, segments {segs}")
    quotes = spark.createDataFrame([(1, "Ulm"), (1, "wohnt [NAME_1] aus"), (1, "[NAME_1]"), (1, "fehlt")], "doc_id long, quote string")
    places = review.located(quotes, texts)
    assert sorted((x.start, x.end, x.text) for x in places.collect()) == [(3, 6, "Ulm"), (7, 12, "wohnt"), (22, 25, "aus"), (26, 29, "Ulm")]
    assert review.suggestions(places, spark.createDataFrame([(1, 3, 6)], "doc_id long, start int, end int")).count() == 3
    assert sorted((x.start, x.end) for x in verify.locate_quotes(spark.createDataFrame([(1, "a  b a b", "a b")], "doc_id long, text string, quote string")).collect()) == [(0, 4), (5, 8)]
    spans = spark.createDataFrame([("k", 0, 5), ("k", 6, 9), ("k", 20, 22)], "name string, start int, end int")
    mark = lambda *x: spark.createDataFrame(list(x), "name string, start int, end int")
    assert {x.start: x.rating for x in review.rated(spans, mark(("k", 0, 9)), mark(("k", 8, 9))).collect()} == {0: "expected", 6: "harmless", 20: "other"}


def test_gold_and_settings(spark):
    texts = spark.createDataFrame([(1, "Gestern kam Ute Kern. Ute ging.")], "doc_id long, text string")
    gold = labels.gold_spans(spark.createDataFrame([(1, "kam «Ute Kern».", "PERSON"), (1, "nicht «da»", "PERSON")], "doc_id long, context string, entity_type string"), texts)
    assert [(x.start, x.end) for x in gold.collect()] == [(12, 20)]
    hits = spark.createDataFrame([(1, 12, 20, "PERSON"), (1, 22, 25, "PERSON"), (1, 26, 30, "PERSON")], "doc_id long, start int, end int, entity_type string")
    neutral = spark.createDataFrame([(1, 22, 25)], "doc_id long, start int, end int")
    assert (report.evaluate(hits, gold, neutral=neutral).first().precision, report.evaluate(hits, gold).first().n_found) == (0.5, 3)
    case = {"name": "c", "text": "Kern und Kern (x)", "redact": [{"text": "Kern", "type": "PERSON"}], "expected": ["(x)"], "harmless": []}
    docs, places = labels.review_cases(spark.createDataFrame([(json.dumps(case),), ("broken",)], "value string"))
    assert docs.count() == 1 and sorted((x.list, x.start, x.end) for x in places.collect()) == [("expected", 14, 17), ("redact", 0, 4), ("redact", 9, 13)]
    s = labels.read_settings('{"threshold": 0.6, "mode": "blackout", "locked": ["mode"], "deny": ["a"]}', '{"threshold": "x", "mode": "numbered", "deny": ["b"]}')
    assert (s.threshold, s.mode, s.deny) == (0.6, "blackout", ["a", "b"])
    assert labels.read_settings("[1]", "no json").threshold == 0.45 and labels.read_settings(None, labels.write_settings(s)).threshold == 0.6
    assert labels.needs_reanalysis(s, d.Settings()) and not labels.needs_reanalysis(d.Settings(), d.Settings(mode="numbered"))


def test_workspace_edits(spark, tmp_path):
    rows = [(1, 1, 0, 3, "PERSON", "Ute", True, "auto"), (2, 1, 4, 7, "PERSON", "Max", True, "auto"), (3, 1, 8, 9, "LOCATION", "x", True, "auto")]
    f = spark.createDataFrame(rows, "id int, doc_id long, start int, end int, entity_type string, text string, active boolean, source string")
    edits = spark.createDataFrame([(1, 1, "toggle", None), (1, 2, "toggle", None), (1, 3, "deactivate", None), (2, 1, "retype", "LOCATION"), (2, 2, "retype", "CUSTOM"), (3, 1, "remove", None)], "id int, n int, action string, entity_type string")
    out = {x.id: x for x in w.apply_edits(f, edits, "n").collect()}
    assert set(out) == {1, 2} and not out[1].active and (out[2].entity_type, out[2].original_type) == ("CUSTOM", "PERSON")
    stats = report.finding_stats(w.apply_edits(f, edits, "n")).first()
    assert (stats.total, stats.active, stats.deselected, stats.retyped, stats.added, stats.areas) == (2, 1, 1, 1, 0, 0)
    added = w.add_manual(w.apply_edits(f, edits, "n"), spark.createDataFrame([(1, 0, 3, "PERSON", "Ute"), (1, 20, 22, "PERSON", "Al"), (1, 5, 5, "PERSON", "")], "doc_id long, start int, end int, entity_type string, text string"))
    assert sorted((x.start, x.active, x.source) for x in added.collect()) == [(0, True, "auto"), (4, True, "auto"), (20, True, "manual")]
    again = w.reanalysed(added.withColumn("active", F.lit(False)), f)
    assert sorted((x.start, x.active, x.source) for x in again.collect()) == [(0, False, "auto"), (4, False, "auto"), (8, True, "auto"), (20, False, "manual")]
    assert [x.start for x in w.deny_everywhere(f, spark.createDataFrame([(" UTE ",)], "term string")).where("not active").collect()] == [0]
    state = spark.createDataFrame([("B", "to_review"), ("a", "waiting"), ("c", "auto")], "rel string, status string")
    assert w.next_open(state, "a").first().rel == "B" and w.next_open(state, "b").first().rel == "a"
    assert {x.status: x.n for x in w.status_counts(state).collect()} == {"to_review": 1, "waiting": 1, "auto": 1}
    step = lambda a, b: one(spark, w.next_status(F.lit(a), F.col("t")), b)
    assert (step("waiting", "analysed"), step("auto", "analysed"), step("auto", "edited"), step("x", "failed"), step("to_review", "exported_human")) == ("to_review", "auto", "to_review", "error", "reviewed")
    assert w.load(spark, f"{tmp_path}/state") is None
    w.save(state, f"{tmp_path}/state")
    w.save(state.limit(1), f"{tmp_path}/state")
    assert w.load(spark, f"{tmp_path}/state").count() == 1


def test_folder_run(spark, tmp_path):
    src = tmp_path / "a+b (1)"
    (src / "sub").mkdir(parents=True)
    (src / ".hidden").mkdir()
    (src / "one.txt").write_text("Mail an eva@firma.de bitte.\r\n", encoding="utf-8")
    (src / "sub" / "two.md").write_bytes("Frau Ute Kern grüßt. Kern war da.".encode("cp1252"))
    for odd in ("~$one.txt", "one_redacted.txt", "x.bin", ".hidden/three.txt"):
        (src / odd).write_text("eva@firma.de")
    assert [x.rel for x in files.scan_folder(spark, str(src)).collect()] == ["one.txt", "sub/two.md"]
    go = lambda: folder.run_folder(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/state", d.Settings(entities=["EMAIL_ADDRESS", "PERSON"]))
    run = go()
    assert run.code == 3 and [(x.rel, x.name, x.redacted_text) for x in run.written.collect()] == [("one.txt", "one_redacted.txt", "Mail an [EMAIL] bitte.\n")]
    assert {x.rel: x.status for x in run.state.collect()} == {"one.txt": "auto", "sub/two.md": "to_review"}
    again = go()
    assert again.written.count() == 0 and again.code == 3
    docs = files.load_documents(spark, str(src))
    assert sorted(x.text for x in folder.findings_of(docs, again.state).collect()) == ["Ute Kern", "eva@firma.de"]
    (src / "one.txt").write_text("Nichts mehr.")
    assert folder.findings_of(files.load_documents(spark, str(src)), go().state).count() == 1
    rows = spark.createDataFrame([("b", "=1"), ("A", "x")], "rel string, note string")
    assert [(x.rel, x.note) for x in report.protocol(rows).collect()] == [("A", "x"), ("b", "'=1")]
    files.write_protocol(rows, f"{tmp_path}/protocol")
    assert spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/protocol").count() == 2


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.org ok"), (2, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    q = stream.start(stream.redact_stream(spark, f"{tmp_path}/in", df.schema, d.Settings(entities=["EMAIL_ADDRESS"])), f"{tmp_path}/out", f"{tmp_path}/ck")
    q.awaitTermination()
    assert sorted((x.doc_id, x.redacted_text) for x in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, "[EMAIL] ok"), (2, "")]


def test_numbers_over_line_ends_without_blanks(spark):
    """A blank beside the line end ends the number; a longer run over it is no card."""
    df = spark.createDataFrame([("4111 1111\n11111111 \n 7",), ("41111111 \n11111111",)], "t string").withColumn("f", F.array().cast(FOUND))
    rows = d.cross_line(df, "t", "f", d.Settings(entities=["CREDIT_CARD"]), blanks=False).collect()
    assert [[(s.start, s.end) for s in r.f] for r in rows] == [[(0, 18)], []]


def test_comparisons_detect_once(spark):
    for q in ("findings_difference", "gold_recall_precision", "gold_errors"):
        plan = queries.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" in plan, q


def test_plain_searches_leave_no_match_out(spark):
    """Each recognizer finds the same with and without the plain search that comes before its pattern."""
    texts = ["a@b.org", "1.2.3.4", "::1 a:b", "+1 (234) 567-8901", 'token = "' + "a" * 32 + '"', "see www.a.de", "http://x.y", "* 1.2.1990", "† 01.02.2003", "Frau Muster", "12/345/67890", "DE123456788", "HRB 12", "1. März 1990", "B-AB 12", "1990-01-02", "\ue000 a@b.org", "none", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    for r in rec.RECOGNIZERS:
        rows = df.select(find_spans("text", r.pattern, r.group).alias("all"), find_spans_needed(r).alias("some")).collect()
        assert all(x.all == x.some for x in rows), r.name


def find_spans_needed(r):
    figures = "coalesce(text rlike '[0-9]', false)"
    return spans_of(marked("text", r.pattern, r.group, r.needed("text", figures)))


def test_pieces_tell_of_every_match(spark, monkeypatch):
    """Recognizers find the same in the pieces that tell of matches as in the whole text, also in texts of very many pieces."""
    some = ["mail a.b@c.org, and; 1.2.3.4! ::1 or ab:cd::1, ", "DE89 3704 0044 0532 0130 00, ", "Frau Dr. med. Ute Krämer-Voss kam; ", "h. c. Max, Herrn Öztürk, Prof. Bär\n", "Anschrift: Alte Gasse 12-14, 50667 Köln\n", "Postfach 12 34 56, x\n", 'token = "' + "a" * 32 + '", ', "www.a.de/x,y;z!, http://b.c? ", "Max, *03.04.1960, † 1.2.1999, geboren am 5. März 1971\n", "HRB 12 , B-AB 12, Tel 0221 123456! 4111 1111 1111 1111\n", " x 12345 Ulm, ", "Pass C01X00T47, MAX STRASSE, "]
    plain = "Lange, leere Worte; ohne jedes Zeichen! und weiter\n"
    texts = [*some, "".join(some), plain + plain.join(some) + plain, "".join((plain + x) * 30 for x in some), plain * 3, "", "\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = sorted({r.entity_type for r in rec.RECOGNIZERS})

    def hits():
        return {x.doc_id: [tuple(f) for f in x.findings] for x in rec.recognized(df, "text", kinds, 0.0).collect()}

    pieces = hits()
    assert len(pieces[12]) > 20 and len(pieces[14]) > rec.MOST_PIECES
    monkeypatch.setattr(rec, "RECOGNIZERS", [replace(r, told=None) for r in rec.RECOGNIZERS])
    assert pieces == hits()


def test_spans_of_very_many_matches(spark):
    """Spans of very many matches are cut out in stretches, not by one fold that copies all of them each time."""
    n, began = 40_000, time.time()
    x = spark.range(1).select(find_spans(F.repeat(F.lit("ab é1 "), F.lit(n)), "[0-9]").alias("s")).select(F.size("s").alias("n"), F.col("s")[n - 1].alias("last"), F.forall(F.transform("s", lambda s, i: s.start == 6 * i + 4), lambda b: b).alias("ok")).first()
    assert (x.n, x.last.start, x.last.end, x.last.text, x.ok) == (n, 6 * n - 2, 6 * n - 1, "1", True)
    assert time.time() - began < 20
