"""Rectangles on pages as tables: columns x0, y0, x1, y1 with the y axis downwards; joins are equi-joins on document and page
with the overlap as a condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SIDES = ("x0", "y0", "x1", "y1")


def rect(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + s) for s in SIDES)


def normalised(df: DataFrame) -> DataFrame:
    """Corners of drawn rectangles in order."""
    x0, y0, x1, y1 = rect()
    return df.withColumns({"x0": F.least(x0, x1), "x1": F.greatest(x0, x1), "y0": F.least(y0, y1), "y1": F.greatest(y0, y1)})


def area(a: tuple[Column, ...]) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def shared_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def inside_fraction(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Share of ``a`` within ``b``: of its area, or of its length where it is a line."""
    along = lambda i, j: F.greatest(F.least(a[j], b[j]) - F.greatest(a[i], b[i]), F.lit(0.0))
    within = lambda i, j: (a[i] >= b[i]) & (a[j] <= b[j])
    flat, upright = a[3] <= a[1], a[2] <= a[0]
    return (
        F.when(flat & upright, F.when(within(0, 2) & within(1, 3), 1.0).otherwise(0.0))
        .when(flat, F.when(within(1, 3), along(0, 2) / (a[2] - a[0])).otherwise(0.0))
        .when(upright, F.when(within(0, 2), along(1, 3) / (a[3] - a[1])).otherwise(0.0))
        .otherwise(shared_area(a, b) / area(a))
    )


def label_size(width: Column, height: Column, text: Column) -> Column:
    """Font size of a label in a bar: as high and as wide as fits, none under 3.5 points."""
    size = F.least(0.72 * height, width / (0.56 * F.greatest(F.length(text), F.lit(1))))
    return F.when(size < 3.5, 0.0).otherwise(size)


def _on_page(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.select(F.col("doc_id").alias("__d"), F.col("page").alias("__p"), *[F.col(s).alias(f"__{s}") for s in SIDES])
    hit = (F.col("x0") < F.col("__x1")) & (F.col("__x0") < F.col("x1")) & (F.col("y0") < F.col("__y1")) & (F.col("__y0") < F.col("y1"))
    return left.join(r, (F.col("doc_id") == F.col("__d")) & (F.col("page") == F.col("__p")) & hit)


def covered_words(words: DataFrame, text_boxes: DataFrame, share: float = 0.4) -> DataFrame:
    """Words of text recognition (doc_id, page, word_id, x0..y1) that lie under text the page has already: those parts of
    its boxes come to ``share`` of the word."""
    j = _on_page(words.select("doc_id", "page", "word_id", *SIDES), text_boxes)
    under = j.groupBy("doc_id", "page", "word_id", *SIDES).agg(F.sum(shared_area(rect(), rect("__"))).alias("under"))
    return under.where(F.col("under") >= share * area(rect())).select("doc_id", "page", "word_id")


def split_glued(words: DataFrame) -> DataFrame:
    """``words`` with those of the form ``label:value`` as two, their box cut by their lengths; the parts of word n are 2 n and
    2 n + 1, so the order stays.

    A label has two letters or more, begins and ends with one (a full stop may follow) and has only letters, digits, ``_``,
    ``-`` and ``.``; a value begins with a letter, digit or ``_``. Words with ``//``, as in addresses, stay whole.
    """
    label, value = F.substring_index("text", ":", 1), F.substring("text", F.instr("text", ":") + 1, F.length("text"))
    sound = label.rlike(r"^\p{L}[\p{L}\p{N}_.-]*$") & label.rlike(r"^.+\p{L}[.]?$")
    glued = F.contains("text", F.lit(":")) & sound & value.rlike(r"^[\p{L}\p{N}_]") & ~F.contains("text", F.lit("//"))
    cut = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.length(label) + 1) / F.length("text")
    part = lambda n, text, x0, x1: F.struct((F.col("word_id") * 2 + n).alias("word_id"), text.alias("text"), x0.alias("x0"), x1.alias("x1"))
    two = F.array(part(0, F.concat(label, F.lit(":")), F.col("x0"), cut), part(1, value, cut, F.col("x1")))
    rest = [c for c in words.columns if c not in ("word_id", "text", "x0", "x1")]
    return words.select(*rest, F.inline(F.when(glued, two).otherwise(F.array(part(0, F.col("text"), F.col("x0"), F.col("x1"))))))


def recognised_chars(words: DataFrame, text_boxes: DataFrame, least_score: float = 0.8) -> DataFrame:
    """Characters (doc_id, page, word_id, i, ch, x0..y1, uncertain) of words (with text, score) that no page text covers;
    the width of a word is dealt evenly to its characters."""
    own = words.join(covered_words(words, text_boxes), ["doc_id", "page", "word_id"], "left_anti").where(F.length("text") > 0)
    step = (F.col("x1") - F.col("x0")) / F.length("text")
    out = own.select("doc_id", "page", "word_id", F.posexplode(F.split("text", "")).alias("i", "ch"), step.alias("w"), *SIDES, (F.col("score") < least_score).alias("uncertain")).where("ch <> ''")
    return out.withColumns({"x1": F.col("x0") + (F.col("i") + 1) * F.col("w"), "x0": F.col("x0") + F.col("i") * F.col("w")}).drop("w")


def unredacted_spots(chars: DataFrame, bars: DataFrame) -> DataFrame:
    """Characters (doc_id, page, ch, x0..y1, is_label) whose middle still lies under a bar, but for those of its label."""
    mid = chars.where("not is_label and trim(ch) <> ''").select("doc_id", "page", "ch", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    b = bars.select("doc_id", "page", *SIDES)
    hit = mid.join(b, ["doc_id", "page"]).where("x > x0 and x < x1 and y > y0 and y < y1")
    return hit.groupBy("doc_id", "page", *SIDES).agg(F.count("*").alias("n_chars"))


def collateral_drawings(drawings: DataFrame, bars: DataFrame, least: float = 0.5) -> DataFrame:
    """Drawings (doc_id, page, drawing_id, x0..y1) that a bar touches although less than ``least`` of them lies in one."""
    j = _on_page(drawings, bars).groupBy("doc_id", "page", "drawing_id").agg(F.max(inside_fraction(rect(), rect("__"))).alias("inside"))
    return j.where(F.col("inside") < least)


def content_image_pages(images: DataFrame, pages: DataFrame, least: float = 0.003) -> DataFrame:
    """(doc_id, page) with an image (doc_id, page, image_id, image_area) that is content: of some size, and, in a document of
    several pages, not repeated on others as letterheads are. ``pages``: (doc_id, page, page_area)."""
    n = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("n_pages"))
    on = images.groupBy("doc_id", "image_id").agg(F.countDistinct("page").alias("n_on"))
    j = images.join(pages, ["doc_id", "page"]).join(n, "doc_id").join(on, ["doc_id", "image_id"])
    return j.where((F.col("image_area") >= least * F.col("page_area")) & ((F.col("n_pages") == 1) | (F.col("n_on") == 1))).select("doc_id", "page").distinct()


def area_ranges(chars: DataFrame, drawn: DataFrame) -> DataFrame:
    """(doc_id, area_id, start, end): ranges of text under drawn areas (doc_id, area_id, page, x0..y1); characters (doc_id,
    pos, ch, page, x0..y1) count by their middle, runs parted by white space only are one."""
    c = chars.select("doc_id", "page", "pos", (F.trim("ch") == "").alias("blank"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    hit = c.join(normalised(drawn).select("doc_id", "page", "area_id", *SIDES), ["doc_id", "page"]).where("x >= x0 and x <= x1 and y >= y0 and y <= y1 and not blank")
    # the number of characters so far that are no white space: neighbours differ by one
    solid = c.withColumn("k", F.sum((~F.col("blank")).cast("long")).over(Window.partitionBy("doc_id").orderBy("pos"))).select("doc_id", "pos", "k")
    w = Window.partitionBy("doc_id", "area_id").orderBy("pos")
    runs = hit.join(solid, ["doc_id", "pos"]).withColumn("g", F.col("k") - F.row_number().over(w))
    return runs.groupBy("doc_id", "area_id", "g").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("g")
