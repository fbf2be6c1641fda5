import time

from lakeveil.llm.html_text import extract_text, host_of, parse


def text(page):
    return "\n\n".join(parse(page).blocks())


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header>
    <nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- x --><div class="ad">Buy</div><div id="cookie-notice">Cookies!</div>
    <article><h1>Head &amp; line</h1><p><b>First  line &lt;one&gt;<br>goes on.<p>Second <i>par</i>t&#39;s end.</p><aside>See also</aside><ul><li>one<li>two</ul>
    <table><tr><td>a</td><td>b</td></tr></table><div class="share">Share</div><section class="comments"><p>Nice!</p></section></article>
    <section class="comments"><article class="comment"><p>First!</p></article></section><form>Name <input></form><footer>&copy; X</footer></body></html>"""
    assert text(page) == "Head & line\n\nFirst line <one> goes on.\n\nSecond part's end.\n\none\n\ntwo\n\na b"


def test_pages_without_article_and_broken_pages():
    assert text("<body><div class=menu><a>Home</a></div><div><p>Long text of the page stands here.</p><p><a>link</a></p></div></body>") == "Long text of the page stands here."
    assert text("<nav><ul><li>menu<article><p>Kept") == "Kept"
    assert text("<main><p>a < b and 3 &gt; 2</p><p>end <b") == "a < b and 3 > 2\n\nend"
    assert text("plain &copy; text") == "plain © text"
    assert text("<p>one<script>document.write('<p>no</p>')</script> two") == "one two"
    assert text("") == "" and text("<script>never closed <p>x") == "" and text("<div hidden>x</div><p style='display:none'>y</p>") == ""
    assert text("<P CLASS='Intro'>Up&nbsp;per</P>") == "Up per"
    assert len(text("<div>" * 3000 + "deep" + "</div>" * 3000)) == 4


def test_hosts():
    assert [host_of(x) for x in ("https://A.example.com:80/x", "http://u@b.org?q", None, "no url")] == ["a.example.com", "b.org", "", ""]


def test_template_removal(spark):
    frame = "<body><div><p>Welcome to our site, read more below.</p></div><div><p>Own text number {i} of this page.</p><p>{extra}</p></div><div><p>All rights.</p></div></body>"
    rows = [(i, f"http://t.example.com/{i}", frame.format(i=i, extra="A copy." if i < 3 else "")) for i in range(20)]
    rows += [(100 + i, f"http://u.example.com/{i}", f"<article><p>One text {'' if i % 2 else i}.</p><p>Sign up now.</p></article>") for i in range(12)]
    rows += [(200, "http://v.example.com/", frame.format(i=1, extra="")), (201, None, None), (202, None, ""), (None, "x", "<p>z"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(a, b, c, "h") for a, b, c in rows], "page_id long, url string, html string, host string").repartition(3)
    out = extract_text(df).collect()
    got = {}
    for r in out:
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert len(out) == len(rows) and got[0] == ["Own text number 0 of this page.\n\nA copy."] * 2
    assert got[7] == ["Own text number 7 of this page."]
    assert got[101] == ["One text ."] and got[102] == ["One text 2."]
    assert got[200] == ["Welcome to our site, read more below.\n\nOwn text number 1 of this page.\n\nAll rights."]
    assert got[201] == [""] and got[202] == [""] and got[None] == ["z"]
    assert extract_text(df.limit(0)).count() == 0


def test_copies_are_no_template(spark):
    page = "<body><div><h1>Title {i}</h1><p>Own text {i}.</p></div></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i=0)) for i in range(4)]  # four copies alone on a host
    rows += [(10 + i, f"http://b.example.com/{max(i - 6, 0)}", page.format(i=max(i - 6, 0))) for i in range(16)]  # one page is 7 of 16 rows
    rows += [(30 + i, f"http://c.example.com/{max(i - 9, 0)}", f"<article><p>Text {max(i - 9, 0)}.</p></article>") for i in range(12)]  # and here 10 of 12
    rows += [(50 + i, f"http://d.example.com/{i}", f"<body>All in the body.</body><!-- {i} -->" if i < 5 else f"<main>Other {i}.<p>Foot.</p></main>") for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in extract_text(df).collect()}
    assert all(got[i] == "Title 0\n\nOwn text 0." for i in range(4))
    assert all(got[10 + i] == f"Title {max(i - 6, 0)}\n\nOwn text {max(i - 6, 0)}." for i in range(16))
    assert all(got[30 + i] == f"Text {max(i - 9, 0)}." for i in range(12))
    assert all(got[50 + i] == ("All in the body." if i < 5 else f"Other {i}.") for i in range(10))


def test_counts_decide(spark):
    """Template that no name gives away goes by the counts alone, and a name in an article deletes nothing by itself."""
    page = "<body><div><p>Home of the site</p><p>Pick a topic</p></div><article><h1>Head {i}</h1><p class='notice'>{note}</p><p>Own text {i}.</p><div><p>Read on in our shop.</p></div></article></body>"
    rows = [(i, f"http://a.example.com/{i}", page.format(i=i, note="We use them." if i % 2 else f"A notice of its own, {i}.")) for i in range(14)]
    rows += [(100 + i, f"http://b.example.com/{i}", f"<body><div><p>Home</p></div><p>Text {i} stands here.</p></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    with_counts, without = ({r.page_id: r.text for r in extract_text(df, c).collect()} for c in (True, False))
    assert with_counts[1] == "Head 1\n\nOwn text 1." and with_counts[2] == "Head 2\n\nA notice of its own, 2.\n\nOwn text 2."
    assert without[1] == "Head 1\n\nWe use them.\n\nOwn text 1.\n\nRead on in our shop."
    assert with_counts[101] == "Text 1 stands here." and without[101] == "Home\n\nText 1 stands here."


def test_time_is_linear_in_the_page():
    for piece in ("<a b ", "<div>x", '<a "', "<h1>x", "<ul><li>x", "<tr><td>x", "<b></i>", "<p><span class=ad>x", "<nav>x", "</div>", "<!", "&amp;"):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            parse(piece * (n // len(piece))).blocks()
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.02), piece


def test_long_pages_and_clashing_columns(spark):
    rows = [(1, "http://a.example.com/", "<article>" + "<p>One paragraph of many.</p>" * 40_000 + "</article>", "x", 5), (2, "http://a.example.com/", "<div>" * 100_000 + "deep", "y", 6)]
    out = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, template string, n_chars int")).collect()}
    assert out[1].count("One paragraph of many.") == 40_000 and out[2] == "deep"


def test_class_words_do_not_cut_article_text():
    parts = ['<section id="related-work"><p>One.</p></section>', '<p class="share-price">Two.</p>', '<p id="ad-hoc-methods">Three.</p>', '<div class="legal comment">Four.</div>', '<div class="no-skip">Five.</div>', '<p class="comment">Six.</p>', '<div class="größe-menu_plan">Seven.</div>', '<blockquote class="share">Eight.</blockquote>']
    assert text("<article>" + "".join(parts) + "</article>").split("\n\n") == ["One.", "Two.", "Three.", "Four.", "Five.", "Six.", "Seven.", "Eight."]
    gone = ['<div class="ad">x</div>', '<div class="share-buttons">x</div>', '<section class="comments" id="comments-list">x</section>', '<div class="ad_box">x</div>', '<ul class="related-posts"><li>x</ul>', "<nav>x</nav>"]
    assert text("<article><p>Kept.</p>" + "".join(gone) + "</article>") == "Kept."


def test_raw_elements_that_never_end_are_linear():
    def seconds(n):
        page = "<article>" + "<noscript>a</noscript ><noscript>b" * 1 + "<noscript>word " * n
        start = time.perf_counter()
        found = text(page)
        return time.perf_counter() - start, found

    seconds(1000)
    small, large = seconds(5_000)[0], seconds(40_000)[0]
    assert large < 24 * small + 0.5
    assert seconds(2)[1] == "bword word"
