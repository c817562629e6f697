"""Pages whose text stands in an element with a noise word, and short blocks beside text."""

import pytest

from tessera.llm import html_text

TEXT = "Long text here, in a sentence or two. " * 5
KEPT = TEXT.strip()


@pytest.mark.parametrize("opening, closing", [("<div class='page with-sidebar'>", "</div>"), ("<div id='nav-wrapper'>", "</div>"), ("<form>", "</form>"), ("<main><div class='content-sidebar-wrap'>", "</div></main>")])
def test_wrapper_keeps_its_text(opening, closing):
    inside = f"<nav><a>Home</a></nav><article><p>{TEXT}</p></article><div class='sidebar'>More</div>"
    assert html_text.main_text(f"<body>{opening}{inside}{closing}<footer>(c) us</footer></body>") == KEPT
    assert html_text.main_text(f"<body>{opening}<p>{TEXT}</p>{closing}<footer>(c) us</footer></body>") == KEPT


def test_long_comments_stay_out():
    page = f"<main><article><p>Short.</p></article><div id='comments'><article>{TEXT}</article></div></main>"
    assert html_text.main_text(page) == "Short."


def test_short_blocks_beside_text():
    page = f"<div><h1>Title</h1></div><div><p>{TEXT}</p></div><div><p>End.</p></div>"
    assert html_text.main_text(page) == f"Title\n\n{KEPT}\n\nEnd."


@pytest.mark.parametrize(
    "page, text",
    [
        ("<article><p>Before the icon.</p><svg class='i'/><p>After it.</p></article>", "Before the icon.\n\nAfter it."),
        ("<html><head><title>T</title><body><article><p>Body</article>", "Body"),
        ("<div class='site has-sidebar'><article><p>Hello</p></article></div>", "Hello"),
        ("<article><p class='promo'>Buy<p>Second<p>Third", "Second\n\nThird"),
        ("<title-card>x</title-card><article><p>Hi</article>", "Hi"),
        ("<article><ul><li class=ad>buy<li>item</ul><table><tr><td class=ad>x<td>cell<tr><td>more</table></article>", "item\n\ncell\n\nmore"),
        ("<article>one<a href='x>two</a> three<p>four</article>", "onetwo three\n\nfour"),
        ("<article>1 < 2 &lt;b&gt; &amp;&nbsp;&eacute;</article>", "1 < 2 <b> & \u00e9"),
    ],
)
def test_markup_that_html_allows(page, text):
    assert html_text.main_text(page) == text


def test_surge_and_dive_decide():
    """A teaser in an article element and scattered words lose to the body in a plain div."""
    gap = "<div></div>" * 3
    page = f"<article>A teaser of some other page</article>{gap}<div><p>{TEXT}<p>{TEXT}</div>{gap}{gap}<div>Odd words</div>{gap}{gap}"
    assert html_text.main_text(page) == f"{KEPT}\n\n{KEPT}"
    # the same words in a page of few words are its surge
    assert html_text.main_text("<div>Odd words</div>") == "Odd words"


def plain_lines(html):
    """A plain reader of the well-formed pages: (text, in an article, noise) of each block."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.out, self.parts = [], [], []

        def cut(self):
            text = " ".join("".join(self.parts).split())
            inside = any(n in ("article", "main") for n, _ in self.open)
            if text and inside and not any(bad for _, bad in self.open):
                self.out.append(text)
            self.parts = []

        def handle_starttag(self, name, attributes):
            if name == "br":
                self.parts.append(" ")
            if name in html_text.BLOCKS:
                self.cut()
            if name not in html_text.VOID:
                bad = name in html_text.SKIPPED or name in html_text.RAW or name == "form" or any(k in ("class", "id") and set(html_text._PARTS(v or "")) & html_text.NOISE_WORDS for k, v in attributes)
                self.open.append((name, bad))

        def handle_endtag(self, name):
            if name in html_text.BLOCKS:
                self.cut()
            if any(n == name for n, _ in self.open):
                while self.open.pop()[0] != name:
                    pass

        def handle_data(self, data):
            if not any(n in ("script", "style") for n, _ in self.open):
                self.parts.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    reader.cut()
    return reader.out


def test_pages_equal_a_plain_reader(spark):
    from tests.conftest import SF
    from tessera.llm.queries import QUERIES

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op1_html_text"](spark, SF).collect():
        assert r.text == "\n\n".join(plain_lines(pages[r.page_id])) and r.n_chars == len(r.text)


def test_malformed_pages_take_linear_time():
    import time

    for piece in ('<a href="x>', "<a ='>'", "<p ", "<div>", '<b ="', "<svg>", "</div>", "<li>&x", '<p class="ad">'):
        began = time.time()
        html_text.main_text("<article>" + piece * 40_000)
        assert time.time() - began < 5


BODY = "Long text here, in a sentence or two. " * 3


@pytest.mark.parametrize(
    "inside, text",
    [
        ("<section class='related-work'><p>Rel</p></section>", "Rel"),
        ("<div class='search-results-analysis'>SRA</div>", "SRA"),
        ("<p id='share-of-votes'>Votes</p>", "Votes"),
        ("<div class='share-buttons'>Tell</div><div class='site-footer'>Foot</div><div class='cookie_notice'>Eat</div>", ""),
        ("<p hidden>No</p><p style='color:red; display: none'>No</p><span hidden=''>No</span><div class='hidden-gem'>Gem</div>", "Gem"),
        ("<p data-hidden='x' title='hidden'>Yes</p>", "Yes"),
    ],
)
def test_class_words_and_hidden_elements(inside, text):
    got = html_text.main_text(f"<article><p>{BODY}</p>{inside}</article>")
    assert got == "\n\n".join(x for x in (BODY.strip(), text) if x)


def test_prose_outside_of_articles_is_kept_wherever_it_stands():
    apart = "<div></div>" * 9
    assert html_text.main_text(f"<div><h1><a>The Title</a></h1><p>{BODY}</p><p><a>All of it a link</a></p></div>") == f"The Title\n\n{BODY.strip()}\n\nAll of it a link"
    assert html_text.main_text((f"<p>one</p>{apart}") * 6) == "\n\n".join(["one"] * 6)
    menu = "<ul><li><a>Home</a></li><li><a>News of today</a></li></ul>"
    assert html_text.main_text(f"{menu}{apart}<div><p>{BODY}</p></div>{apart}{menu}") == BODY.strip()
    assert html_text.main_text("<h1><a>Only this</a></h1>") == "Only this"


def test_window_sums_choose_on_real_pages(spark):
    """With one line a window and no threshold but the page's highest sum, pages keep less."""
    from tests.conftest import SF

    pages = [r.html or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    fewer = [len(html_text.main_text(p, 1, 10**9)) < len(html_text.main_text(p)) for p in pages]
    assert sum(fewer) > 0.8 * len(pages)
