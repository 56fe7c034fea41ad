"""Main text of web pages by two-pass block rules.

A page becomes a list of blocks: the text between two block-level tags. Pass one decides what it can: blocks in menus, headers,
footers, sidebars, notices, adverts, forms and comments, and blocks that are mostly links, are boilerplate; long blocks with enough
stop words, or in a script without spaces, are text. A class or id names boilerplate by its last part. Pass two gives every other block the label of its nearest decided neighbours. Inside an article a block is
boilerplate only if both neighbours in its section are. Elsewhere the nearer one counts, first in the block's section of the page,
then on the whole page; at equal distance a heading looks ahead, and others are boilerplate. What markup alone decides has no say there.

Defined results: null and empty pages have no text. Tags without an end, ends without a tag, stray ``<`` and unfinished comments are
taken as a browser would take them, near enough. Ids, urls and repeated rows pass as they are.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import quoted

#: Characters from which a block with enough stop words is text by itself; share of stop words; share of linked characters.
LONG, STOPS, LINKED = 70, 0.15, 0.33
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by can for from had has have he her his i if in into is it its more no not of on one or our out she so
    such than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich
    ihr im in ist ja kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wer wie wir wird zu zum zur
    ai au aux avec ce ces cette comme dans de des du elle en est et eu il ils je la le les leur lui ma mais me même mes mon ne nos notre nous
    on ont ou où par pas plus pour qu que qui sa se ses son sont sur ta te tu un une vous y été être
    al algo como con cual cuando de del desde donde el ella en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero
    por que qué se ser si sin sobre son su sus también te tiene todo un una uno y ya
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form
    frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot
    th thead tr ul
    """.split()
)
#: Block tags that need no end; their own hint holds until the next block.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption pre hr option summary legend col colgroup optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
SECTION_TAGS = frozenset("article main section nav aside header footer form menu dialog search".split())
#: Words in class, id or role that mark boilerplate.
HINTS = frozenset(
    """
    ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification
    alert popup modal overlay newsletter subscribe subscription signup login sidebar rail complementary widget menu nav navbar navigation breadcrumb
    breadcrumbs footer masthead toolbar topbar share sharing social related recommended recommendations comment comments reply replies respond disqus
    discussion pagination pager search form copyright legal disclaimer skip contentinfo tags tagcloud hidden
    """.split()
)
#: A class whose name begins so tells something of its element and doesn't name it: has-sidebar, no-comments.
ABOUT = frozenset("has no not is are with without hide hides show shows can js".split())
#: Last parts of class names that say what shape a thing has, not what it is: ad-box, comment-list, related-posts.
SHAPES = frozenset(
    """
    area article articles bar block body box card cell column container content group holder inner item items layer link links list outer panel post posts
    region row section slot stories story unit view wrap wrapper zone
    """.split()
)
#: Scripts without spaces, in which sentences have no stop words between spaces, and their punctuation.
_SPACELESS = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff]")
_SENTENCE = re.compile(r"[。、，！？；]")
#: Characters from which a block in such a script is text by itself, with and without punctuation.
DENSE, DENSE_PLAIN = 30, 70
#: Elements whose content is never shown. The first ones hold raw text: without an end they reach to the end of the page.
RAW = frozenset("script style textarea title iframe noscript".split())
UNSEEN = RAW | frozenset("template svg math object select button canvas audio video map".split())
#: Every alternative that begins to match also ends, at the latest with the page, so the time is linear in the page.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"'=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)|<",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_STRIP = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’…¿¡"


@dataclass
class Block:
    text: str
    n_words: int
    link_share: float
    stop_share: float
    heading: bool
    section: int
    in_article: bool
    boilerplate: bool
    label: bool | None = None


def hinted(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether a tag marks boilerplate. A header inside an article belongs to it."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
        if name in ("class", "id", "role") and any(names_boilerplate(x, in_article) for x in value.split()):
            return True
    return False


def names_boilerplate(name: str, in_article: bool) -> bool:
    """Whether a class name or id names boilerplate: by its last part, apart from shapes and numbers, of a name that isn't about
    something else."""
    parts = [w.lower() for w in _WORDS.findall(name)]
    if not parts or parts[0] in ABOUT:
        return False
    kept = list(parts)
    while len(kept) > 1 and kept[-1] in SHAPES:
        kept.pop()
    return kept[-1] in HINTS or (kept[-1] == "header" and not in_article and "article" not in parts)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, not yet labelled."""
    out: list[Block] = []
    # Open containers: tag, section, inside an article, boilerplate.
    stack: list[tuple[str, int, bool, bool]] = []
    parts: list[tuple[str, bool]] = []
    sections, linked, heading, leaf, at = 0, False, False, False, 0

    def close() -> None:
        nonlocal parts, sections
        if parts:
            text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
            if text:
                links = sum(len(" ".join(html.unescape(p).split())) for p, in_link in parts if in_link)
                words = text.split()
                stops = sum(w.lower().strip(_STRIP) in STOP_WORDS for w in words)
                _, section, inside, bad = stack[-1] if stack else ("", 0, False, False)
                if leaf:  # a hidden paragraph says nothing about those beside it
                    sections += 1
                    section = sections
                out.append(Block(text, len(words), min(1.0, links / len(text)), stops / len(words), heading, section, inside, bad or leaf))
            parts = []

    endless: set[str] = set()
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            parts.append((page[at : m.start()], linked))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m[0] == "<":
                parts.append(("&lt;", linked))
        elif tag in UNSEEN:
            if not m["end"] and tag not in endless and not m["attributes"].endswith("/"):
                if last := re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at):
                    at = last.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    endless.add(tag)
        elif tag == "a":
            linked = not m["end"]
        elif tag == "br":
            parts.append((" ", False))
        elif tag in BLOCK_TAGS:
            close()
            linked = heading = leaf = False
            inside = bool(stack) and stack[-1][2]
            if tag in LEAVES:
                if not m["end"]:
                    heading, leaf = tag in HEADINGS, hinted(tag, m["attributes"], inside)
            elif m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif not m["attributes"].endswith("/"):
                bad = hinted(tag, m["attributes"], inside)
                section = stack[-1][1] if stack else 0
                if bad or tag in SECTION_TAGS:
                    sections += 1
                    section = sections
                stack.append((tag, section, inside or tag in ("article", "main"), bad or (bool(stack) and stack[-1][3])))
    if at < len(page):
        parts.append((page[at:], linked))
    close()
    return out


def decide(block: Block) -> bool | None:
    """Pass one: True for text, False for boilerplate, None if the block alone doesn't tell."""
    if block.boilerplate or block.link_share > LINKED:
        return False
    if len(block.text) >= LONG and block.stop_share >= STOPS:
        return True
    if len(block.text) >= DENSE and 2 * len(_SPACELESS.findall(block.text)) > len(block.text) and (len(block.text) >= DENSE_PLAIN or _SENTENCE.search(block.text)):
        return True
    return None


def label(blocks: list[Block]) -> list[Block]:
    """Both passes. Pass two looks only at what pass one decided."""
    labels = [decide(b) for b in blocks]
    before, after = _decided(labels, blocks, 1), _decided(labels, blocks, -1)
    for k, b in enumerate(blocks):
        b.label = labels[k]
        if b.label is None:
            b.label = _inherit(k, b, before[k], after[k])
    return blocks


def _decided(labels: list[bool | None], blocks: list[Block], way: int) -> list[tuple]:
    """For each block the last decided one before it (way 1) or after it (way -1): in its section, and anywhere."""
    out: list[tuple] = [()] * len(blocks)
    last: dict[int, tuple[int, bool]] = {}
    anywhere: tuple[int, bool] | None = None
    for k in range(len(blocks))[::way]:
        out[k] = (last.get(blocks[k].section), anywhere)
        if labels[k] is not None and not blocks[k].boilerplate:  # markup speaks for its own content only
            anywhere = last[blocks[k].section] = (k, labels[k])
    return out


def _inherit(k: int, block: Block, before: tuple, after: tuple) -> bool:
    for mine in (0, 1):
        a, b = before[mine], after[mine]
        if block.in_article:
            return not (a and b and not a[1] and not b[1])
        if a and b and a[1] != b[1]:
            if k - a[0] != b[0] - k:
                return a[1] if k - a[0] < b[0] - k else b[1]
            return b[1] if block.heading else False
        if a or b:
            return (a or b)[1]
    return True


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in label(blocks_of(page or "")) if b.label)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` of every page."""
    own = pages.select(F.col(quoted(key)).alias("page_id"), F.col(quoted(url)).alias("url"), F.col(quoted(page)).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = dict(own.dtypes)
    return own.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def label_blocks(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Every block of every page with its figures and label."""
    schema = "page_id long, block int, text string, n_words int, link_share double, stop_share double, heading boolean, is_text boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (i, k, b.text, b.n_words, b.link_share, b.stop_share, b.heading, b.label)
                for i, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, b in enumerate(label(blocks_of(p or "")))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return pages.select(F.col(quoted(key)).cast("long"), F.col(quoted(page))).mapInArrow(run, schema)
