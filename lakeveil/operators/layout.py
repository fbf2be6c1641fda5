"""Pages as tables of characters: text from characters, bars over findings, need of text recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from lakeveil.functions.spans import last_at_or_before


#: Order of the lines of a document; recognised text follows the text a page has already.
READING = ["page", "is_ocr", "block", "line"]
#: Share of a character's height that a bar leaves free above and below, so that it keeps to its line.
INSET = 0.35
#: A line's characters with less in common than this height get a bar each.
LEAST_BAND = 1.0
#: Recognised characters stand about where they are said to: margins of their bars to the sides, above and below.
OCR_MARGIN = (2.5, 1.5)
#: What a finding is known by.
FINDING = ["doc_id", "start", "end", "entity_type"]


def document_from_chars(chars: DataFrame) -> DataFrame:
    """(doc_id, text) from (doc_id, pos, ch); one document's characters are one text."""
    return chars.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x.ch), "").alias("text"))


def lines_of_chars(chars: DataFrame) -> DataFrame:
    """(doc_id, page, is_ocr, block, line, text) from characters (doc_id, page, block, line, n, ch), n their order in the line. A
    row may hold several characters that follow one another from n on: give stretches where a page has them, as every row is
    sent and sorted by itself."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("n", "ch"))), lambda x: x.ch)
    return chars.groupBy("doc_id", "page", "block", "line").agg(F.array_join(in_order, "").alias("text")).select("doc_id", "page", F.lit(False).alias("is_ocr"), "block", "line", "text")


def lines_of_words(words: DataFrame) -> DataFrame:
    """The same from recognised words (doc_id, page, line, word_id, text): one block a page, one blank between words."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("word_id", "text"))), lambda x: x.text)
    return words.groupBy("doc_id", "page", "line").agg(F.array_join(in_order, " ").alias("text")).select("doc_id", "page", F.lit(True).alias("is_ocr"), F.lit(0).alias("block"), "line", "text")


def placed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` with ``start``, ``end`` (code points in the document) and ``ending``: a line feed after each line, one more
    after each block.

    Places are a running sum over lines, not characters, so a document is dealt as its lines and a line's characters follow
    from its start. A null text is an empty line; rows without a document are left out. Repeated lines stand twice.
    """
    own = lines.where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    order = Window.partitionBy("doc_id").orderBy(*READING, "text")
    same = F.lead(F.struct("page", "is_ocr", "block")).over(order).eqNullSafe(F.struct("page", "is_ocr", "block"))
    own = own.withColumn("ending", F.when(same, "\n").otherwise("\n\n"))
    before = F.sum(F.length("text") + F.length("ending")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("start", F.coalesce(before, F.lit(0)).cast("int"))
    return own.withColumn("end", F.col("start") + F.length("text"))


def page_text(placed: DataFrame) -> DataFrame:
    """(doc_id, text, page_starts, ocr) from ``placed_lines``: the whole text, where each page begins, as
    array<struct<page, start>>, and the recognised lines as array<struct<start, end>>, both in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text", "ending"))), lambda x: F.concat(x.text, x.ending)), "")
    starts = F.array_sort(F.collect_list(F.when(F.col("opens"), F.struct("page", "start"))))
    ocr = F.array_sort(F.collect_list(F.when(F.col("is_ocr") & (F.col("end") > F.col("start")), F.struct("start", "end"))))
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    opens = ~F.coalesce(F.lag("page").over(order).eqNullSafe(F.col("page")), F.lit(False)) | (F.row_number().over(order) == 1)
    return placed.withColumn("opens", opens).groupBy("doc_id").agg(text.alias("text"), starts.alias("page_starts"), ocr.alias("ocr"))


def page_at(page_starts, pos):
    """Page that holds a position: the last one that starts at or before it, the first one for a position before all."""
    return F.coalesce(last_at_or_before(page_starts, "start", pos), F.try_element_at(page_starts, F.lit(1))).page


def is_ocr(ocr, start, end):
    """Whether a range holds a recognised character: the last recognised line that starts before its end reaches into it."""
    return F.coalesce(last_at_or_before(ocr, "start", end - 1).end > start, F.lit(False)) & (end > start)


def redaction_plan(findings: DataFrame, boxes: DataFrame) -> DataFrame:
    """Bars over findings: (doc_id, start, end, entity_type, page, line, x0, y0, x1, y1, first), one for a finding, page and
    line; ``first`` is where the label goes.

    Findings are dealt into their positions and joined with the boxes (doc_id, pos, page, line, x0..y1) by document and
    position: as many rows as there are characters and characters found, however many findings a document has. Where the
    boxes of a finding stand on its row already, ``bars`` takes them without that join.
    """
    recognised = F.col("is_ocr") if "is_ocr" in boxes.columns else F.lit(False)
    b = boxes.where("x1 > x0 and y1 > y0").select("doc_id", F.col("pos").cast("long").alias("pos"), "page", "line", recognised.alias("is_ocr"), "x0", "y0", "x1", "y1")
    # findings that stand twice are one
    f = findings.where(F.col("start") < F.col("end")).select(*FINDING).distinct()
    f = f.withColumn("pos", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1)))
    return bars(f.join(b, ["doc_id", "pos"]))


def bars(covered: DataFrame) -> DataFrame:
    """``redaction_plan`` from the boxes of the characters found: (doc_id, start, end, entity_type, page, line, x0..y1), one row for
    each box of each finding.

    A bar is as wide as its characters and as high as what they have in common, less a margin. Characters with no such
    band get one each; recognised ones (``is_ocr``, if there is such a column) a bar of full height with a margin around it.
    Boxes without an extent cover nothing; rows without a document are left out.
    """
    recognised = F.col("is_ocr") if "is_ocr" in covered.columns else F.lit(False)
    boxed = covered.where("x1 > x0 and y1 > y0 and doc_id is not null").withColumn("is_ocr", recognised)
    margin = INSET * (F.col("y1") - F.col("y0"))
    core = F.struct("x0", (F.col("y0") + margin).alias("y0"), "x1", (F.col("y1") - margin).alias("y1"))
    lines = boxed.withColumn("core", core).groupBy(*FINDING, "page", "line").agg(
        F.array_sort(F.collect_list("core")).alias("cores"), F.max("is_ocr").alias("is_ocr"), F.min("x0").alias("x0"), F.max("x1").alias("x1"),
        F.min("y0").alias("low"), F.max("y1").alias("high"), F.max("core.y0").alias("y0"), F.min("core.y1").alias("y1"))
    beside, above = OCR_MARGIN
    full = F.struct((F.col("x0") - beside).alias("x0"), (F.col("low") - above).alias("y0"), (F.col("x1") + beside).alias("x1"), (F.col("high") + above).alias("y1"))
    band = (F.col("y1") - F.col("y0") >= LEAST_BAND) | (F.size("cores") == 1)
    own = F.when(F.col("is_ocr"), F.array(full)).when(band, F.array(F.struct("x0", "y0", "x1", "y1"))).otherwise(F.col("cores"))
    out = lines.select(*FINDING, "page", "line", F.inline(own))
    return out.withColumn("first", F.row_number().over(Window.partitionBy(*FINDING).orderBy("page", "line", "x0", "y0", "x1", "y1")) == 1)


def needs_ocr(pages: DataFrame) -> DataFrame:
    """``pages`` (n_chars, n_images, image_area, page_area) with ``needs_ocr``: no text but images, or little text under
    images over half of the page."""
    share = F.try_divide("image_area", "page_area") >= 0.5
    return pages.withColumn("needs_ocr", F.when(F.col("n_chars") > 200, False).when(F.col("n_images") == 0, False).when(F.col("n_chars") == 0, True).otherwise(F.coalesce(share, F.lit(False))))


def chunks(text_col: str, most: int):
    """Array of (start, end) that cover a text without gaps, cut after the last blank line of the second half of each
    chunk, else after the last line feed there, else hard. A fold in the JVM; a null text has no chunk."""
    if most < 2:
        raise ValueError("a chunk has two characters or more")
    t, half = F.coalesce(F.col(text_col), F.lit("")), most // 2
    kind = "array<struct<start:int,end:int>>"

    def step(s, _):
        window = F.reverse(F.substring(t, s.at + half + 1, F.lit(most - half)))
        blank, feed = F.instr(window, "\n\n"), F.instr(window, "\n")
        cut = F.when(blank > 0, s.at + most - blank + 1).when(feed > 0, s.at + most - feed + 1).otherwise(s.at + most)
        end = F.when(F.length(t) - s.at > most, cut).otherwise(F.length(t)).cast("int")
        grown = F.concat(s["found"], F.array(F.struct(s.at.alias("start"), end.alias("end"))))
        return F.struct(end.alias("at"), F.when(s.at < F.length(t), grown).otherwise(s["found"]).alias("found"))

    steps = F.sequence(F.lit(0), F.floor(F.length(t) / max(1, half)).cast("int"))  # a chunk is longer than half of the most
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("found")), step, lambda s: s["found"])
