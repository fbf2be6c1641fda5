import random

from pyspark.sql import functions as F

from lakeveil.functions import spans, text as tx
from lakeveil.operators import geometry, layout, report, verify
from lakeveil.operators import redact as r
from lakeveil.plans import queries

BOX = "doc_id long, pos int, ch string, page int, line int, x0 double, y0 double, x1 double, y1 double"
FOUND = "doc_id long, start int, end int, entity_type string"


def plain_pages(lines):
    """(text, page starts, recognised ranges) of one document's lines, one after the other."""
    text, starts, ocr = "", [], []
    order = sorted(lines, key=lambda x: (x[1], x[2], x[3], x[4], x[5] or ""))
    for i, (_, page, seen, block, _, t) in enumerate(order):
        if not starts or starts[-1][0] != page:
            starts.append((page, len(text)))
        if seen and t:
            ocr.append((len(text), len(text) + len(t)))
        same = i + 1 < len(order) and (order[i + 1][1], order[i + 1][2], order[i + 1][3]) == (page, seen, block)
        text += (t or "") + ("\n" if same else "\n\n")
    return text, starts, ocr


def test_page_text_equals_one_pass(spark):
    rng = random.Random(5)
    lines = [(d, p, seen, 0 if seen else b, i, rng.choice(["ab", "", "ü😀x", None, "c" * 30])) for d in (1, 2) for p in (0, 1, 4) for seen in (False, True) for b in (0, 3) for i in range(rng.randint(0, 3))]
    lines += lines[:2] + [(None, 0, False, 0, 0, "lost")]
    df = spark.createDataFrame(lines, "doc_id long, page int, is_ocr boolean, block int, line int, text string").repartition(3)
    pos = F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("pos")
    out = layout.page_text(layout.placed_lines(df))
    at = out.select("doc_id", "page_starts", "ocr", pos).select("doc_id", "pos", layout.page_at(F.col("page_starts"), F.col("pos")).alias("page"), layout.is_ocr(F.col("ocr"), F.col("pos"), F.col("pos") + 2).alias("seen"))
    places = {(x.doc_id, x.pos): (x.page, x.seen) for x in at.collect()}
    rows = {x.doc_id: x for x in out.collect()}
    assert set(rows) == {1, 2}
    for d, x in rows.items():
        text, starts, ocr = plain_pages([line for line in lines if line[0] == d])
        assert (x.text, [tuple(s) for s in x.page_starts], [tuple(s) for s in x.ocr]) == (text, starts, ocr)
        for i in range(len(text)):
            assert places[d, i] == ([p for p, s in starts if s <= i][-1], any(s < i + 2 and i < e for s, e in ocr))
    assert layout.page_text(layout.placed_lines(df.limit(0))).count() == 0


def test_lines_from_characters_and_words(spark):
    chars = spark.createDataFrame([(1, 0, 0, 0, i, c) for i, c in enumerate("ab c")] + [(1, 0, 0, 1, 0, "d")], "doc_id long, page int, block int, line int, n int, ch string").repartition(4)
    words = spark.createDataFrame([(1, 0, 9, 2, "here"), (1, 0, 9, 1, "read")], "doc_id long, page int, line int, word_id int, text string")
    out = layout.page_text(layout.placed_lines(layout.lines_of_chars(chars).unionByName(layout.lines_of_words(words)))).first()
    assert out.text == "ab c\nd\n\nread here\n\n" and [tuple(x) for x in out.ocr] == [(8, 17)]


def test_lookup_by_halving(spark):
    keys = [3, 3, 7, 20, 21]
    df = spark.range(-1, 24).select(F.col("id").cast("int").alias("p"), F.array(*[F.lit(k) for k in keys]).alias("k"))
    for n in range(len(keys) + 1):
        got = df.select("p", spans.count_at_or_before(F.slice("k", 1, n), F.col("p")).alias("n")).collect()
        assert [x.n for x in got] == [sum(k <= x.p for k in keys[:n]) for x in got]
    items = F.transform("k", lambda x: F.struct(x.alias("at"), (x * 2).alias("v")))
    got = df.select("p", spans.last_at_or_before(items, "at", F.col("p")).v.alias("v")).collect()
    assert [x.v for x in got] == [next((2 * k for k in reversed(keys) if k <= x.p), None) for x in got]


def plain_bars(found, boxes):
    out = set()
    for d, s, e, kind in set(found):
        rows = {}
        for b in boxes:
            if b[0] == d and s <= b[1] < e and b[7] > b[5] and b[8] > b[6]:
                rows.setdefault((b[3], b[4]), []).append(b)
        bars = []
        for (page, line), own in rows.items():
            cores = [(b[5], b[6] + 0.35 * (b[8] - b[6]), b[7], b[8] - 0.35 * (b[8] - b[6])) for b in own]
            band = (min(c[0] for c in cores), max(c[1] for c in cores), max(c[2] for c in cores), min(c[3] for c in cores))
            bars += [(page, line, *c) for c in ([band] if band[3] - band[1] >= 1 or len(own) == 1 else cores)]
        out |= {(d, s, e, kind, *b, i == 0) for i, b in enumerate(sorted(bars))}
    return out


def test_bars_equal_the_plain_join(spark):
    rng = random.Random(2)
    boxes = [(d, i, "x", i // 90, i // 15, 5.0 * i, (i // 15) * 12.0, 5.0 * i + rng.choice([0.0, 5.0, 5.0, 5.0]), (i // 15) * 12.0 + rng.choice([1.0, 9.0, 10.0, 10.0])) for d in (1, 2) for i in range(180)]
    found = [(d, s, s + rng.randint(0, 25), rng.choice(["A", "B"])) for d in (1, 2, 3) for s in rng.sample(range(170), 20)] + [(1, 0, 180, "ALL"), (1, 0, 180, "ALL"), (1, 5, 4, "NONE")]
    f, b = spark.createDataFrame(found, FOUND), spark.createDataFrame(boxes, BOX)
    plan = layout.redaction_plan(f, b)
    assert {(x.doc_id, x.start, x.end, x.entity_type, x.page, x.line, x.x0, x.y0, x.x1, x.y1, x["first"]) for x in plan.collect()} == plain_bars(found, boxes)
    assert "CartesianProduct" not in plan._jdf.queryExecution().toString() and "NestedLoop" not in plan._jdf.queryExecution().toString()
    seen = layout.redaction_plan(spark.createDataFrame([(1, 0, 2, "A")], FOUND), spark.createDataFrame([(1, 0, "x", 0, 0, 10.0, 10.0, 20.0, 20.0), (1, 1, "y", 0, 0, 20.0, 10.0, 30.0, 20.0)], BOX).withColumn("is_ocr", F.lit(True))).first()
    assert (seen.x0, seen.y0, seen.x1, seen.y1) == (7.5, 8.5, 32.5, 21.5)
    assert layout.redaction_plan(f.limit(0), b).count() == layout.redaction_plan(f, b.limit(0)).count() == 0


def test_glued_words_are_parted(spark):
    words = ["Geburtsdatum:17.11.1984", "Tel.:030", "Größe:groß", "http://x.de", "a:b", "9a:b", "ab:", ":ab", "ab:,c", "a-b:c:d", "plain", None]
    want = [["Geburtsdatum:", "17.11.1984"], ["Tel.:", "030"], ["Größe:", "groß"], ["http://x.de"], ["a:b"], ["9a:b"], ["ab:"], [":ab"], ["ab:,c"], ["a-b:", "c:d"], ["plain"], [None]]
    df = spark.createDataFrame([(i, w, 0.0, 10.0 * len(w or "")) for i, w in enumerate(words)], "word_id int, text string, x0 double, x1 double")
    rows = geometry.split_glued(df.withColumn("score", F.lit(0.5))).orderBy("word_id").collect()
    got = [[x.text for x in rows if x.word_id // 2 == i] for i in range(len(words))]
    assert got == want
    assert [(x.x0, x.x1) for x in rows[:2]] == [(0.0, 130.0), (130.0, 230.0)] and {x.score for x in rows} == {0.5}


def _one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


def test_values_are_found_by_their_words(spark):
    find = lambda value, text: [s.text for s in (_one(spark, spans.find_spans("t", tx.word_pattern(F.lit(value))), text) or [])]
    assert find("KAYA.", "antrag_kaya_2.pdf") == ["kaya"]
    assert _one(spark, tx.word_pattern("t"), "1 2") is None and _one(spark, tx.word_pattern("t"), "") is None and _one(spark, tx.word_pattern("t"), None) is None
    assert find("1 2 3", "123 and 1 2 3") == ["123", "1 2 3"]
    assert find("Ende", "Wochenende, Ende, akte_ende.pdf") == ["Ende", "ende"] and find("4711", "14711 4711") == ["4711"]
    words = lambda t: _one(spark, tx.name_words("t"), t)
    assert words("Herrn Prof. Dr. Ali Kaya!") == ["Ali", "Kaya"] and words("Frau") == ["Frau"] and words("Herr Dr.") == ["Dr"]
    assert words("Anna Dr. Kaya") == ["Anna", "Dr.", "Kaya"] and words("...") == []
    assert _one(spark, tx.surname("t"), "Kaya, Ali") == "Kaya" and _one(spark, tx.surname("t"), "Herr Kaya") is None
    hit = lambda t, s, e: _one(spark, verify.surname_hit(F.col("t"), F.lit(s), F.lit(e), F.substring("t", s + 1, e - s)), t)
    assert not hit("der\nKern", 4, 8) and hit("und\nKern", 4, 8)


def test_placeholders_are_no_leftovers(spark):
    f = "struct<start:int,end:int,entity_type:string,text:string,active:boolean>"
    df = spark.createDataFrame([(1, "Name Name", [(0, 4, "PERSON", "Name", True), (5, 9, "PERSON", "Name", True)]), (2, "Name Name", [(0, 4, "PERSON", "Name", True)])], f"doc_id long, text string, findings array<{f}>")
    out = r.redact(df)
    assert "[NAME]" in out.first().redacted_text.upper()
    assert [(x.doc_id, x.n) for x in verify.leftovers(out).collect()] == [(2, 1)]


def test_misses_and_false_alarms(spark):
    gold = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "A"), (2, 0, 5, "B")], FOUND)
    found = spark.createDataFrame([(1, 4, 6, "A"), (1, 10, 15, "B"), (3, 0, 2, "A"), (3, 5, 9, "A")], FOUND)
    row = lambda x: (x.error, x.doc_id, x.start, x.entity_type)
    assert sorted(map(row, report.misses_and_false_alarms(found, gold).collect())) == [("false alarm", 1, 10, "B"), ("false alarm", 3, 0, "A"), ("false alarm", 3, 5, "A"), ("miss", 1, 10, "A"), ("miss", 2, 0, "B")]
    neutral = spark.createDataFrame([(3, 8, 12)], "doc_id long, start int, end int")
    assert ("false alarm", 3, 5, "A") not in set(map(row, report.misses_and_false_alarms(found, gold, neutral=neutral).collect()))


def test_bars_of_boxes_on_the_row_equal_the_join(spark):
    rng = random.Random(3)
    chars = [(1, p, "x", p // 20, p // 10, 5.0 * (p % 10), 12.0 * (p // 10), 5.0 * (p % 10) + 5.0 * (p % 7 > 0), 12.0 * (p // 10) + rng.choice([1.0, 6.0, 10.0])) for p in range(60)]
    boxes = spark.createDataFrame(chars, BOX)
    found = spark.createDataFrame([(1, a, a + rng.randrange(1, 15), k) for a in range(0, 45, 4) for k in ("A", "B")], FOUND)
    row = found.alias("f").join(boxes.alias("b"), F.expr("f.doc_id = b.doc_id and b.pos >= f.start and b.pos < f.end")).select("f.*", "page", "line", "x0", "y0", "x1", "y1")
    assert sorted(layout.bars(row).collect()) == sorted(layout.redaction_plan(found, boxes).collect())


def test_stretches_of_characters_are_lines(spark):
    chars = spark.createDataFrame([(1, 0, 0, 0, 2, "cd"), (1, 0, 0, 0, 0, "ab"), (1, 0, 0, 0, 4, "e")], "doc_id long, page int, block int, line int, n int, ch string")
    assert [x.text for x in layout.lines_of_chars(chars).collect()] == ["abcde"]


def test_bars_and_page_text_deal_no_single_characters_of_the_documents(spark):
    plan = lambda q: queries.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan("finding_bars") and "(?s)(.)" not in plan("page_text")
