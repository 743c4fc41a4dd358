"""Main text of pages against a plain reading of the article element, and on odd pages."""

import html as lib
import re

import pytest

from acervo.llm.html_text import extract_text, main_text, smoothed, threshold


def article(page):
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|ul|li|div)>", inside)
    texts = (lib.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)) for x in parts)
    return "\n".join(" ".join(x.split()) for x in texts if x.split())


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = extract_text(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("page, text", [
    ("", ""), ("<nav>a</nav>", ""), ("<script>x", ""), ("plain", "plain"), ("<p>a<!-- c -->b &amp; &#233;\n c</p>", "ab & é c"),
    ("<main><article><header><h1>T</h1><p>by me</p></header><p>One <b>two</b>.<p>3</article><div class='comments'>no</div></main>", "T\nOne two.\n3"),
    ("<div id=menu><a href=a>x</a></div><div class=post><h1>T</h1><p>Long text with many words, and more.</p><p>S.</p></div>"
     "<div class='side-bar sidebar'>q</div><ul><li><a href=b>l</a></ul>", "T\nLong text with many words, and more.\nS."),
    ("<article><p>a</p><form>f</form><aside>n</aside><div class='ad'>x</div><p>b</p><ul><li>c<li>d</ul></article><footer>z", "a\nb\nc\nd"),
    ("<body class=has-sidebar><div class=modal><article>in</article></div>", "in"),
])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_smoothing_and_threshold():
    assert smoothed([5.0]) == [5.0]
    assert smoothed([3.0, 3.0, 3.0]) == pytest.approx([3.0] * 3)
    assert 2 < threshold([1, 2, 50, 60]) < 50
    assert threshold([4, 4]) == 4


def test_nulls_repeats_long_and_empty(spark):
    long = "<article>" + "<p>word word</p>" * 40_000 + "</article>"
    rows = [(1, "u", None, "x"), (None, None, "<p>a", "y"), (1, "u", "", "z"), (1, "u", "", "z"), (2, "v", long, "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = got.collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, 1, 40_000 * 10 - 1]
    assert extract_text(pages.limit(0)).count() == 0


def test_articles_named_or_not(spark, sf):
    """Ratios find the same text where div stands for article; of several articles all are returned."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    div = lambda page: re.sub("(</?)article>", r"\1div>", page)
    several = 0
    for page, other in zip(pages, pages[1:] + pages[:1]):
        assert main_text(div(page)) == article(page)
        second = re.search("<article>.*?</article>", other, re.S)
        if second and "</article>" in page:
            two, want = page.replace("</article>", "</article>" + second[0], 1), f"{article(page)}\n{article(second[0])}"
            assert main_text(two) == want and main_text(div(two)) == want
            several += 1
    assert several > 10


def test_ratios_select_beside_and_within_articles():
    body = "".join(f"<p>{'Plain words of a long text, ' * 12}{i}.</p>" for i in range(8))
    links = "<ul>" + "".join(f"<li><a href=x{i}>go {i}</a></li>" for i in range(12)) + "</ul>"
    text = main_text(f"<article>{body}{links}</article>")
    assert "Plain words" in text and "go 5" not in text
    text = main_text(f"<article><p>Teaser.</p></article><div>{body}</div>{links}")
    assert text.count("\n") >= 7 and "go 5" not in text


def page(body):
    return f"<html><body><nav><a href=1>Home</a><a href=2>About</a></nav>{body}<footer>All rights</footer></body></html>"


PROSE = "<p>" + "Plain words of a paragraph stand here. " * 12 + "</p>"


def test_links_that_belong_to_an_article_stay():
    got = main_text(page(
        f"<article><h1><a href=x>My linked title</a></h1>{PROSE}<p><a href=y>A paragraph that is one link</a></p>{PROSE}"
        "<h2>Sources</h2><ul><li><a href=a>First source</a></li><li><a href=b>Second source</a></li></ul></article>")).split("\n")
    assert [got[0], got[2], *got[4:]] == ["My linked title", "A paragraph that is one link", "Sources", "First source", "Second source"]
    links = "".join(f"<li><a href=a>Story {i}</a></li>" for i in range(30))
    more = main_text(page(f"<article><h1>Title</h1>{PROSE * 3}<ul>{links}</ul></article>"))
    assert "Story 20" not in more and more.startswith("Title\n")
    announced = main_text(page(f"<article><h1>Title</h1>{PROSE * 3}<h2>References</h2><ul>{links}</ul></article>"))
    assert announced.endswith("Story 29") and "Story 29" not in main_text(page(f"<article><h1>Title</h1>{PROSE * 3}<h2>Related articles</h2><ul>{links}</ul></article>"))


def test_names_within_an_article():
    got = main_text(page(
        f"<article><div class='post-header'><h1>A title</h1></div><div id='related-work'>{PROSE}</div><div class='form-intro'><p>Intro of the form.</p></div>{PROSE}"
        "<div class='related-posts'><p>Elsewhere on this site</p></div><div class='share'><p>Tell others</p></div><div class='post-comments'><p>I think so too.</p></div></article>"))
    assert got.startswith("A title\nPlain words") and "Intro of the form." in got
    assert not any(w in got for w in ("Elsewhere", "Tell others", "I think so"))


def test_the_lead_of_an_article_stays():
    got = main_text(page(f"<article><header><h1>T</h1><p class=lead>What it is about.</p><p class=byline>By someone</p></header>{PROSE}</article>"))
    assert got.startswith("T\nWhat it is about.\nPlain words") and "By someone" not in got


def test_time_grows_with_the_page_and_not_its_depth():
    import time

    for body in ("<div>a" * 100_000, "<main><article>x y</article>" * 20_000, "<ul><li>a" * 50_000, "<p>a</section>" * 50_000, "<article>" + "<div>a" * 50_000):
        start = time.process_time()
        main_text(body)
        assert time.process_time() - start < 10
