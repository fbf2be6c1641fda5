"""Main text of web pages by site template removal (operator 7).

A scanner turns a page into blocks of text and the tree of elements around them, with a hash of every subtree that holds
text, menus and headers included. The subtrees are counted for each host in Spark, once for each distinct content of a page;
those that recur across many pages of their host are template and are deleted with all they hold. What an element is called
decides only how often it must recur: a name that may mean a notice or a promotion lowers the bar, but does not delete a
part of an article by itself. In an article only a class or id that is nothing but such names (``comments``, ``share-buttons``,
``ad-box``) says what an element is; one that holds such a word among others (``share-price``, ``related-work``) says nothing. Elements that are no text by their kind (menus, footers, asides, forms, comments, adverts) go
as well, as they need not be the same on two pages. Pages are parsed once, in time linear in their length.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lakeveil.llm.common import Scratch

#: A subtree is template if it is on so many pages of its host at least, and on this share of them.
MIN_PAGES, SHARE = 4, 0.3
#: Inside an article the text itself may recur (near copies), so only what nearly all pages have is template there.
MIN_PAGES_ARTICLE, SHARE_ARTICLE = 10, 0.75
#: An element whose name hints at template, wherever it stands.
MIN_PAGES_HINT, SHARE_HINT = 2, 0.02
#: Outside an article: blocks of which more than this part of the characters is links are menus.
LINK_PART = 0.6

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|([^\s=/>\"']+)")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)

RAW = {"script", "style", "template", "iframe", "noscript", "textarea", "xmp", "noembed", "noframes", "title"}
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
GONE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "head", "fieldset", "datalist", "label"}
BLOCK = set("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CELL = {"td", "th"}
#: Elements that hold a whole text: never template themselves, only parts of them are.
WHOLE = {"html", "body", "main", "article"}
#: An opening tag closes these if they are open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that a closing or implied end does not reach beyond.
SCOPE = (BLOCK | CELL) - {"p"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id that name what is no main text.
NAMES = set(
    "ad ads adbox adsense advert adverts advertisement advertisements advertising sponsor sponsored cookie cookies consent gdpr"
    " sidebar aside menu nav navbar navigation navi breadcrumb breadcrumbs topbar footer comment comments disqus replies respond share sharing"
    " related newsletter subscribe subscription signup login popup popover modal overlay paywall pagination pager skip hidden".split()
)
#: Words that name it or a part of the text. Outside an article they count as NAMES; in one they lower the bar for counts.
HINTS = set("notice notices alert banner promo promotion promotions promoted discussion reply social recommended recommendations widget disclaimer copyright toolbar masthead header".split())
#: Words that go with NAMES in the name of a part of a page.
PARTS = set("area bar block box button buttons container content form inner items link links list main nav outer panel posts section widget wrap wrapper articles stories pages top bottom left right site page post article".split())
#: Elements that are text by their kind: their name alone never deletes them in an article.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "table", "tbody", "tr", "td", "th", "li", "dl", "dt", "dd", "figure", "figcaption", "caption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "alertdialog"}
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(source: str) -> dict[str, str]:
    return {(a or c).lower(): v.strip("\"'") if v else "" for a, v, c in _ATTRIBUTE.findall(source)}


def kind_of(tag: str, source: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no part of the main text by its kind, and whether its name hints at template."""
    if tag in GONE or (tag == "header" and not in_article):
        return True, False
    if not source or tag in ("html", "body", "main"):
        return False, False
    a = _attributes(source)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True, False
    names = f"{a.get('class', '')} {a.get('id', '')}".lower().split()
    words = {w for name in names for w in _WORD.findall(name)}
    hint = bool(words & HINTS)
    if tag == "article":
        return bool(words & {"comment", "comments", "reply", "related", "ad", "ads", "advert", "sponsored", "promo"}), False
    if in_article:
        return tag not in TEXTUAL and bool(words & NAMES) and words <= NAMES | HINTS | PARTS, hint
    return bool(words & NAMES) or hint, hint


class Page:
    """Blocks of a page in order and the elements around them. Element i has a parent (an earlier element, or -1), the hash
    of its subtree (0: it holds no text or is a WHOLE), and whether it is no text by its kind. The two lowest bits of a hash
    say whether the subtree is in an article and whether its name is a hint, so each is counted for itself."""

    def __init__(self):
        self.parents: list[int] = []
        self.hashes: list[int] = []
        self.gone: list[bool] = []
        self.texts: list[str] = []
        self.at: list[int] = []  # element of a block
        self.article: list[bool] = []
        self.menu: list[bool] = []  # more than LINK_PART of it is links

    def blocks(self, template: set[int] = frozenset()) -> list[str]:
        """The blocks of the main text, without those in elements whose hash is in ``template``."""
        out = list(self.gone)
        for i, (up, h) in enumerate(zip(self.parents, self.hashes)):
            out[i] = out[i] or h in template or (up >= 0 and out[up])
        left = [(t, a, m) for t, i, a, m in zip(self.texts, self.at, self.article, self.menu) if i < 0 or not out[i]]
        if any(a for _, a, _ in left):
            return [t for t, a, _ in left if a]
        return [t for t, _, m in left if not m]


def _tag_end(page: str, at: int, no_more: set[str]) -> int:
    """Place after the tag whose name ends at ``at``; quoted values may hold its end sign. -1: the page has no further one.
    ``no_more``: quotation marks (and names of tags) known not to come again, so that no stretch is searched twice."""
    k = at
    while True:
        m = _STOP.search(page, k)
        if m is None:
            return -1
        if m[0] == ">":
            return m.end()
        close = -1 if m[0] in no_more else page.find(m[0], m.end())
        if close < 0:
            no_more.add(m[0])
            k = m.end()  # a mark that is never closed is none
        else:
            k = close + 1


def parse(page: str) -> Page:
    out = Page()
    # open elements: tag, number or -1, what the subtree holds so far, whether it is an article, whether it is a hint
    stack: list[tuple[str, int, list[str], bool, bool]] = [("", -1, [], False, False)]
    number = [-1]  # of the innermost numbered element, by depth
    count: dict[str, int] = {}  # open elements by tag
    text: list[str] = []
    articles = links = linked = gone = at = 0
    no_more: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if text:
            raw = "".join(text)
            text.clear()
            clean = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if clean:
                out.texts.append(clean)
                out.at.append(number[-1])
                out.article.append(articles > 0)
                out.menu.append(linked > LINK_PART * len(raw.strip()))
                stack[-1][2].append(clean)
            linked = 0

    def pop() -> None:
        nonlocal articles, links, gone
        tag, own, held, article, hint = stack[-1]
        if tag in BLOCK or own >= 0:
            flush()
        elif tag in CELL:
            text.append(" ")
        stack.pop()
        number.pop()
        count[tag] -= 1
        if held:
            h = xxhash.xxh64_intdigest("\x1f".join(held), seed=len(tag)) >> 1
            stack[-1][2].append(f"{tag}\x1e{h}")
            if own >= 0 and tag not in WHOLE:
                out.hashes[own] = (h & ~3) | (articles > 0) | hint << 1 or 4
        articles -= article
        links -= tag == "a"
        gone -= own >= 0 and out.gone[own]

    def close(tags, reach) -> None:
        """Close the innermost open element among ``tags``, as long as no element of ``reach`` stands over it."""
        if not any(count.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k][0] in reach:
                return

    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            text.append(page[at:start])
            linked += (start - at) * (links > 0)
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        ends = page.startswith("</", start)
        m = _NAME.match(page, start + 1 + ends)
        if m is None:
            text.append("<")
            at = start + 1
            continue
        at = _tag_end(page, m.end(), no_more)
        if at < 0:  # what starts a tag and never ends is none, and no other tag can follow
            break
        tag, source = m[0].lower(), page[m.end() : at - 1]
        if ends:
            if tag == "br":
                text.append(" ")
            elif tag in BLOCK or tag in CELL:
                close((tag,), ())
            else:
                close((tag,), SCOPE)
            continue
        if tag in RAW:
            end = None if tag in no_more else _END[tag].search(page, at)
            if end is None:
                no_more.add(tag)  # none follows
            if end or tag != "noscript":
                k = page.find(">", end.start()) if end else -1
                at = n if k < 0 else k + 1
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text.append(" ")
            continue
        if tag in ("article", "main"):  # a menu or header that was never closed ends where the article starts
            while gone:
                pop()
        if tag in BLOCK and tag not in ("body", "html"):
            close(("p",), SCOPE)  # a block ends an open paragraph
        if tag in HEADINGS and stack[-1][0] in HEADINGS:
            pop()
        if tag in CLOSES:
            while any(x[0] in CLOSES[tag] for x in stack[-1:]) or (stack[-1][0] == "p" and len(stack) > 2 and stack[-2][0] in CLOSES[tag]):
                pop()
            close(CLOSES[tag], SCOPE - CLOSES[tag])
        if source.endswith("/") and tag not in BLOCK:
            continue
        block = tag in BLOCK
        if not block and tag not in CELL and tag != "a" and not source:
            continue  # what only marks words has no part in the structure
        if block:
            flush()
        is_gone, hint = kind_of(tag, source, articles > 0)
        if not block and tag not in CELL and tag != "a" and not is_gone:
            continue
        own = -1
        if block or is_gone:
            if is_gone:
                flush()
            own = len(out.parents)
            out.parents.append(number[-1])
            out.hashes.append(0)
            out.gone.append(is_gone)
        stack.append((tag, own, [], tag == "article", hint))
        number.append(own if own >= 0 else number[-1])
        count[tag] = count.get(tag, 0) + 1
        articles += tag == "article"
        links += tag == "a"
        gone += is_gone
    while len(stack) > 1:
        pop()
    flush()
    return out


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_LISTS = {"texts": pa.string(), "at": pa.int32(), "article": pa.bool_(), "menu": pa.bool_(), "parents": pa.int32(), "hashes": pa.int64(), "gone": pa.bool_()}
_PARSED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), *[(k, pa.list_(v)) for k, v in _LISTS.items()]])
_DDL = "page_id long, url string, host string, texts array<string>, at array<int>, article array<boolean>, menu array<boolean>, parents array<int>, hashes array<long>, gone array<boolean>"


def _parse(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            urls = part.column(1).to_pylist()
            pages = [parse(x or "") for x in part.column(2).to_pylist()]
            lists = [pa.array([getattr(x, k) for x in pages], pa.list_(v)) for k, v in _LISTS.items()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(urls, pa.string()), pa.array([host_of(u) for u in urls], pa.string()), *lists], schema=_PARSED)


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _rest(batches):
    """The main text of parsed pages with the template of their host as a last column."""
    for batch in batches:
        texts = []
        columns = [batch.column(i) for i in range(2, 2 + len(_LISTS) + 1)]
        for row in range(batch.num_rows):
            page = Page()
            for k, c in zip(_LISTS, columns):
                setattr(page, k, c[row].as_py())
            texts.append("\n\n".join(page.blocks(set(columns[-1][row].as_py() or ()))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXT)


def extract_text(pages: DataFrame, counted: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html). ``counted``: delete what recurs.

    A null or empty html, and one without main text, gives an empty text. Pages without a url or host share an empty host
    name. Very long pages are read whole, in linear time. Repeated rows are extracted each. Pages of a host with the same
    blocks are copies and count once, in what recurs and in the number of pages, so a text is no template for being stored
    often; only MIN_PAGES_ARTICLE counts copies under different urls, beside MIN_PAGES distinct contents. A null page_id
    stays null. An empty table gives an empty result; further columns are ignored.

    The template of a host is bounded: of subtrees on a share of its pages there are at most as many as a page has
    elements, divided by the share. It is joined by host, which adaptive execution broadcasts if it is small as a whole.
    """
    scratch = Scratch(pages.sparkSession, "html")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = scratch.table("parsed", own.mapInArrow(_parse, _DDL).withColumn("content", F.xxhash64("texts", "hashes")).withColumn("row", F.monotonically_increasing_id()))
    lists = ["page_id", "url", *_LISTS]
    if not counted:
        return parsed.select(*lists, F.array().cast("array<long>").alias("template")).mapInArrow(_rest, "page_id long, url string, text string, n_chars long")

    # the first row of a content stands for its copies: it counts 1 less the others, which count 1 each
    copies = parsed.groupBy("host", "content", F.xxhash64("url").alias("u")).agg(F.count("*").alias("n"), F.min("row").alias("row"))
    copies = copies.groupBy("host", "content").agg(F.sum("n").alias("n"), F.count("*").alias("urls"), F.min("row").alias("row")).where("n > 1")
    copies = scratch.table("copies", copies.select("row", (2 - F.col("n")).alias("first"), (1 + F.col("urls") - F.col("n")).alias("first_urls")))
    held = parsed.select("row", "host", "hashes").join(copies, "row", "left").withColumn("one", F.coalesce("first", F.lit(1))).withColumn("url_one", F.coalesce("first_urls", F.lit(1)))

    each = held.select("host", "one", "url_one", F.explode(F.array_distinct(F.filter("hashes", lambda h: h != 0))).alias("hash"))
    often = each.groupBy("host", "hash").agg(F.sum("one").alias("n"), F.sum("url_one").alias("urls")).where(F.col("n") >= MIN_PAGES_HINT)
    sizes = held.groupBy("host").agg(F.sum("one").alias("pages"))
    share = lambda least, part: (F.col("n") >= least) & (F.col("n") >= part * F.col("pages"))
    hint, article = F.col("hash").bitwiseAND(2) != 0, F.col("hash").bitwiseAND(1) != 0
    recurs = F.when(hint, share(MIN_PAGES_HINT, SHARE_HINT)).when(article, (F.col("urls") >= MIN_PAGES_ARTICLE) & share(MIN_PAGES, SHARE_ARTICLE)).otherwise(share(MIN_PAGES, SHARE))
    template = often.join(sizes, "host").where(recurs).groupBy("host").agg(F.collect_list("hash").alias("template"))
    template = scratch.table("template", template)
    return parsed.join(template, "host", "left").select(*lists, "template").mapInArrow(_rest, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op7_html_text": op7_html_text}
SQL: dict[str, str] = {}
