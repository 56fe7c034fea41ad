import time

import pytest

from tabwright.llm import html_text as ht

GOOD = "This is a paragraph of the article, and it has enough of the words that are in all of the texts."
BAD = "All of the things that are in this box are here for you to buy, and it is not the text of the page."
PAGE = f"""<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>The title</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body class="home page-sidebar"><header class="site"><h1>The site</h1><p>{BAD}</p></header><div id="cookie-notice"><p>{BAD}</p></div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About &amp; more</a></li></ul></nav><!-- <p>{BAD}</p> -->
<main><article><header><h2>Head&shy;line &lt;1&gt;</h2><p class="byline">By A. Author</p></header><p>{GOOD} <a href="x">With a link</a>&nbsp;&eacute;.
<p>Short.<br>Line</p><ul><li>one</li><li>two</li></ul><div class="ad-box">{BAD}</div><aside>{BAD}</aside><blockquote><p>Zyx abc</blockquote>
<p hidden>{BAD}</p><p style="display: none">{BAD}</p><p class="notice">{BAD}</p><p><a href="/c">A paragraph that is nothing but one long link to another page of the site</a></p><p>Last 5 < 6 one</article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>{BAD}</p></div></section><form><p>{BAD}</p><textarea>{BAD}</textarea></form></main>
<div class="sidebar"><p>{BAD}</p></div><footer><p>{BAD}</p>&copy; us</footer></body></html>"""


def test_article_without_its_surroundings():
    assert ht.main_text(PAGE) == "\n".join(
        ["Head\xadline <1>", "By A. Author", f"{GOOD} With a link é.", "Short. Line", "one", "two", "Zyx abc", "Last 5 < 6 one"]
    )


def test_labels_pass_to_ambiguous_blocks():
    links = '<div><a href="/x">one link and another link</a></div>'
    page = f"<body>{links}<div>near the menu</div>{links}<div>heading like</div><div>{GOOD}</div><div>between</div><div>{GOOD}</div><div>after</div>{links}</body>"
    got = [(b.text, b.label) for b in ht.label(ht.blocks_of(page)) if len(b.text) < 20]
    assert got == [("near the menu", False), ("heading like", False), ("between", True), ("after", False)]
    headed = page.replace("<div>heading like</div>", "<h2>heading like</h2>")
    assert dict((b.text, b.label) for b in ht.label(ht.blocks_of(headed)))["heading like"] is True


def test_sections_come_first():
    page = f"<nav><a href=/>x</a></nav><section><p>close to the menu</p><p>so is this</p><p>and this</p><p>{GOOD}</p></section>"
    assert ht.main_text(page).startswith("close to the menu\nso is this")


@pytest.mark.parametrize(
    ("page", "text"),
    [("", ""), (None, ""), ("<p>hi", "hi"), ("plain &amp; text", "plain & text"), ("<script>x", ""), ("a<!-- open", "a"), ("<div>a</span></div></div>b", "a\nb"), ("<article><p>Auxpa.</p></article><footer>x</footer>", "Auxpa."), ("<p>x<svg><text>no</text></svg>y</p>", "xy"), ("<p>a<button>b</p>c", "ab\nc"), ("<p title='a>b'>c</p>", "c"), ("<P>Up</P><DIV CLASS=AD>no</DIV>", "Up")],
)
def test_odd_pages(page, text):
    assert ht.main_text(page) == text


@pytest.mark.parametrize("part", ["<p>", "<", "<a ", "<!--", "<script ", '<p title="', "<div class='x", "</", "<svg>", "<div>", "<b>x", "&", "<p><i", "<button>"])
def test_time_is_linear(part):
    began = time.time()
    ht.main_text(part * 60_000)
    assert time.time() - began < 5


def test_spark(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", f"<p>{GOOD}</p>" * 3000)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(2)
    got = ht.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, u, ht.main_text(h), len(ht.main_text(h))) for i, u, h in rows), key=str)
    blocks = ht.label_blocks(pages).filter("page_id = 1").collect()
    assert len(blocks) == 2 * len(ht.blocks_of(PAGE)) and {b.is_text for b in blocks} == {True, False}
    assert ht.extract(pages.limit(0)).count() == 0 and ht.label_blocks(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["entry has-sidebar", "post no-comments", "content share-ready", "withSidebar", "is-menu-open", "adaptive", "formatted", "header-image-post article"])
def test_classes_that_only_mention_boilerplate(name):
    assert ht.main_text(f'<body><div class="{name}"><p>{GOOD}</p></div></body>') == GOOD


@pytest.mark.parametrize("name", ["sidebar", "left-sidebar", "post-comments", "commentList", "ad-box", "ad_slot_2", "related-posts", "site-header", "nav-links", "entry sidebar"])
def test_classes_that_name_boilerplate(name):
    assert ht.main_text(f'<body><div class="{name}"><p>{BAD}</p></div><div><p>{GOOD}</p></div></body>') == GOOD


def test_scripts_without_spaces():
    menu = "".join(f'<li><a href="/{k}">項目{k}番</a></li>' for k in range(8))
    first = "これは記事の最初の段落で、空白のない文章がどのように扱われるかを確かめるためのものです。"
    page = f"<body><div><ul>{menu}</ul></div><div><h1>見出し</h1><p>{first}</p><p>短い。</p><p>{first}</p></div><div><ul>{menu}</ul></div></body>"
    assert ht.main_text(page) == f"見出し\n{first}\n短い。\n{first}"
