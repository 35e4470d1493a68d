import pytest

from promptframe.llm.pages import Settings, blocks, extract, main_text

BODY = "It was the best of the days that we have had in the house by the sea, and all of it is still in my mind. " * 3


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("<div>", ""), ("<!-- only -->", ""),
    (f"<article><h1>A title</h1><p>{BODY}<p>Short.</article>", f"A title {BODY.strip()} Short."),
    ("<nav><a href=x>Home</a></nav><article><h1>Tiny</h1><p>ok</article><footer>&copy; x</footer>", "Tiny ok"),
    (f"<div class='sidebar'>{BODY}</div><div><p>{BODY}</p></div><div id=comments><p>{BODY}</div>", BODY.strip()),
    (f"<header>Site</header><main><p>{BODY}<form>Join us <input></form><aside>More</aside><p>{BODY}</main>",
     f"{BODY}{BODY.strip()}"),
    (f"<article><p>{BODY}</p><div class='ad'>{BODY}</div><script>var a='</p>';</script><style>p{{}}</style></article>",
     BODY.strip()),
    ("<article><p>a &amp; b &lt;c&gt; &#233;&nbsp;x\n\t y<br>z</article>", "a & b <c> é x y z"),
    (f"<ul><li><a href=a>{BODY}</a></ul><p>{BODY}</p>", BODY.strip()),
    (f"<div class='cookie-notice'>{BODY}</div><article>{BODY}</article>", BODY.strip()),
])
def test_main_text(html, text):
    assert main_text(html or "") == text


def test_short_blocks_inherit_from_their_neighbours():
    page = f"<p>{BODY}</p><p>So it is.</p><p>{BODY}</p><div><a href=x>Link one</a> <a href=y>Link two</a></div><p>Read on.</p>"
    text = main_text(page)
    assert "So it is." in text and "Link" not in text and "Read on." not in text


def test_links_and_headings_are_known():
    found = blocks("<h2>Head</h2><p>see <a href=x>this page</a></p>")
    assert [(b.text, b.linked, b.heading) for b in found] == [("Head", 0, True), ("see this page", 9, False)]


def test_rows(spark):
    rows = [(1, "u", None, 1), (2, None, f"<article>{BODY}</article>", 2), (2, None, f"<article>{BODY}</article>", 2),
            (3, "v", "<p>" * 20000 + BODY * 300, 3), (4, "w", "<a title=\"" * 3000, 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r.page_id, len(r.text)) for r in extract(df).collect())
    assert got == [(1, 0), (2, len(BODY) - 1), (2, len(BODY) - 1), (3, len(BODY) * 300 - 1), (4, 0)]
    assert extract(df.limit(0)).count() == 0


LINKED = "It was <a href=a>the house</a> of <a href=b>a man who had been to the sea</a>, and it is in <a href=c>a town</a>. " * 3


@pytest.mark.parametrize("block, text", [
    (LINKED, "It was the house of a man who had been to the sea, and it is in a town. " * 3),
    ("See also: <a href=a>Harbour</a>, <a href=b>Ships</a>", "See also: Harbour, Ships"),
    ("<a href=a>Only a link</a>", "Only a link"), ("* * *", "* * *"), ("&mdash; " * 40, "— " * 40)])
def test_links_and_signs_inside_an_article_inherit(block, text):
    text = text.strip()
    for before, after in ((BODY, BODY), (BODY, ""), ("", BODY), ("Tiny.", "ok"), ("", "")):
        page = f"<nav>{LINKED}</nav><article><p>{before}</p><p>{block}</p><p>{after}</p></article><div>{block}</div>"
        assert main_text(page) == " ".join(x.strip() for x in (before, text, after) if x)
    # outside an article, and in parts of it that never hold text, they stay out
    assert main_text(f"<p>{BODY}</p><div>{block}</div><p>{BODY}</p>") == f"{BODY}{BODY.strip()}"
    assert main_text(f"<article><p>{BODY}</p><aside>{block}</aside><p>{BODY}</p></article>") == f"{BODY}{BODY.strip()}"


@pytest.mark.parametrize("inner, text", [
    ('<p title="a hidden gem">Kept.</p>', "Kept."), ('<h2 id="social">Social life</h2>', "Social life"),
    ('<section id="social"><p>Talk.</p></section>', "Talk."), ('<div class="share-price-history"><p>Up.</p></div>', "Up."),
    ('<div class="modal-logic"><p>Box.</p></div>', "Box."), ("<script src=/a/>alert(1)</script>", ""),
    ("<p data-x='<b hidden>' lang=en>Fine.</p>", "Fine."), ("<p hidden>No.</p>", ""), ("<p hidden=until-found>No.</p>", ""),
    ('<section class="comments"><p>First!</p></section>', ""), ('<div class="comment-list"><p>First!</p></div>', ""),
    ('<div class=social-share-buttons>Share</div>', ""), ('<div id="newsletter-signup">Join</div>', ""),
    ('<p class="note" data-role="x">Noted.<br/>Twice.</p>', "Noted. Twice.")])
def test_attributes_are_read_as_browsers_do(inner, text):
    page = f"<body><article><p>{BODY}</p>{inner}<p>{BODY}</p></article></body>"
    assert main_text(page) == " ".join(x for x in (BODY.strip(), text, BODY.strip()) if x)


@pytest.mark.parametrize("body", ["これは日本語の文章です。とても長い段落がここにあります。" * 12,
                                  "Il gatto dorme sopra il tavolo mentre fuori piove e nessuno parla piano. " * 6])
def test_languages_without_a_list_of_stop_words(body):
    body = body.strip()
    page = f"<nav><a href=a>Home</a></nav><div><p>{body}</p><p>{body}</p></div><footer>x</footer><div><a href=b>Link one</a></div>"
    assert main_text(page) == f"{body} {body}"


def test_thresholds_decide_without_an_article():
    page = f"<p>{BODY}</p><p>Short words only here.</p><div>{'Lorem ipsum dolor sit amet consectetur. ' * 8}</div>"
    usual = main_text(page)
    assert BODY.strip() in usual and "Lorem" not in usual
    assert main_text(page, Settings(long=10_000, short=5_000)) != usual
    assert "Lorem" in main_text(page, Settings(stop_low=0.0, stop_high=0.0))
