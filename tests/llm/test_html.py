import html
import re

import pytest

from tessera.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>Head title</title><style>p{}</style><script>var t="</p>";</script></head><body class="main">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- hidden --><aside>Side</aside>
%s
<form><input value=x><label>Search</label></form><footer>&copy; Site</footer></body></html>"""


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>Title &amp; more</h1><p>First\n  para <b>bold</b>.</p><p>Be.</p></article>", "Title & more First para bold. Be."),
        ("<main><p>One<br>two</p><div class='ad'>Buy</div><p>three<p>four</main>", "One two three four"),
        ("<article><p>Text</p><div class='share-buttons'>Share</div><aside>rel</aside><section id=comments><p>me too</p></section></article><div class=comments>hi</div>", "Text"),
        ("<div id='content'><p>A &lt;tag&gt; &#65;&#x42; &nbsp; end</p><table><tr><td>c1<td>c2</table><ul><li>x<li>y</ul></div>", "A <tag> AB end c1 c2 x y"),
        ("<article><header><h1>In</h1></header><p>x</p><script>1<2</script><template>t</template></article>", "In x"),
        ("<article></article>", ""),
        ("<div class='content has-sidebar'><p>kept</p><div class='sidebar-left'>gone</div></div>", "kept"),
        ("<div class='post-comments'>gone</div><div class='postBody entry'><p>kept</p></div>", "kept"),
        ("<p>Short.</p><p>" + "many words in here " * 20 + "</p><p>End.</p>", "Short. " + ("many words in here " * 20).strip() + " End."),
    ],
)
def test_regions(body, text):
    assert html_text.extract(PAGE % body) == text


def test_ratio_regions_without_markup():
    long = " ".join(["plenty of words in a paragraph"] * 12)
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><a href=3>About</a></div><p>{long} one</p><p>Short.</p><p>{long} two</p><div><a href=4>More</a></div></body>"
    assert html_text.extract(page) == f"{long} one Short. {long} two"
    assert html_text.smooth([0, 0, 9, 0, 0])[2] < 9
    assert html_text.content_region([]) == (0, 0, [])


@pytest.mark.parametrize("page", [None, "", "   ", "<p></p>", "<script>x</script>", "<!-- only"])
def test_nothing_there(page):
    assert html_text.extract(page) == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<script>var a = '<!--';</script><article><p>Text</p></article>", "Text"),
        ("<article><p title='<!-- x'>Text</p></article>", "Text"),
        ("<!-- hidden --!><article><p>Text</p></article>", "Text"),
        ("<article><p>Text</p><!-- open <p>hidden</p></article>", "Text"),
        ("<article><p>Text</p><!-- done --><p>more</p><!-- <b>open", "Text more"),
    ],
)
def test_comments_stand_where_the_parser_says(page, text):
    assert html_text.extract(page) == text


LONG = "This paragraph of the article has many words in it, as paragraphs of articles do, and then some more. " * 3


@pytest.mark.parametrize(
    "body",
    [
        f"<article><p>One. {LONG}</p><section id='discussion'><h2>Discussion</h2><p>Two. {LONG}</p></section></article>",
        f"<article><p>One. {LONG}</p><div class='related-work'><h2>Discussion</h2><p>Two. {LONG}</p></div></article>",
        f"<div><p>One. {LONG}</p><section class='reviews legal tags'><h2>Discussion</h2><p>Two. {LONG}</p></section></div>",
    ],
)
def test_doubtful_names_drop_no_article_sections(body):
    assert html_text.extract(PAGE % body) == f"One. {LONG.strip()} Discussion Two. {LONG.strip()}"


def test_doubtful_names_go_where_ratios_say_so():
    related = "<div class='related'>" + "".join(f"<a href=/{i}>Another story of ours, number {i}</a> " for i in range(30)) + "</div>"
    body = f"<article><p>{LONG}</p><div class='notice'>Terms apply.</div>{related}</article>"
    assert html_text.extract(PAGE % body) == LONG.strip()


def test_ratios_choose_between_article_and_the_rest():
    """An article element with next to nothing in it is not the content of a page."""
    paragraphs = "".join(f"<p>{k} {LONG}</p>" for k in range(6))
    page = f"<body><article><p>Hi.</p></article><nav>Menu</nav><div>{paragraphs}</div></body>"
    assert html_text.extract(page) == " ".join(f"{k} {LONG.strip()}" for k in range(6))


def brute_article(page):
    article = re.search(r"<article>(.*?)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|br)>", article[1]) if article else []
    return " ".join(b for b in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in blocks) if b)


def test_pages_table(spark, sf_dir):
    """The generated pages have one article: its blocks, entities decoded."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for row in html_text.op3_html(spark, sf_dir).collect():
        want = brute_article(pages[row["page_id"]])
        assert row["text"] == want and row["n_chars"] == len(want)


@pytest.mark.parametrize("markup", ["<article>", "<div>"])
def test_clusters_choose_on_every_page(spark, monkeypatch, markup):
    """At sf0.01 the region comes from ratios on all pages, whether they declare their article or not."""
    regions = []
    find = html_text.content_region
    monkeypatch.setattr(html_text, "content_region", lambda ratios: regions.append(find(ratios)) or regions[-1])
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    right = 0
    for page in pages:
        plain = page.replace("<article>", markup).replace("</article>", markup.replace("<", "</"))
        right += html_text.extract(plain) == brute_article(page)
    assert len(regions) == len(pages)
    assert right == len(pages)
