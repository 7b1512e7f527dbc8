"""Main text of web pages by block rules in two passes.

A page is cut into blocks at its block-level tags. The first pass decides a block by its link density, its length and
its density of stop words, and by where it stands: what is marked as a menu, footer and the like is bad, and in an
article no block is bad for a lack of stop words or for links within a sentence, but open. Short blocks are open too.
In the second pass an open block inherits the label of its nearest decided neighbour.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigraph.llm.common import table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")
QUOTED = re.compile(r"""("[^"]*"|'[^']*')""")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
UNSEEN = re.compile(r"""\bstyle\s*=\s*(["'])[^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)

# HTML tag names.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "annotation", "annotation-xml"}
RAW_ENDS = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike",
    "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
AWAY = {"nav", "footer", "aside", "form", "button", "select", "option", "dialog", "menu", "head"}
ARTICLE = {"article", "main"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption"}
CLOSED_BY_THE_NEXT = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
WRAPPERS = {"div", "section", "form", *ARTICLE}
# Words in class names, ids and roles that mark what isn't the article.
AWAY_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "pagination", "popup", "promo", "promotion",
    "replies", "respond", "sharing", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Words that do so alone or with words of their kind, but have other senses too (related-work, legal-history).
AWAY_ALONE = {"alert", "conversation", "disclaimer", "discussion", "discussions", "feedback", "legal", "notice", "notices", "related", "reply", "search", "share", "social", "tags"}
# Words that say nothing of what a part of a page is for.
PLAIN_NAMES = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "column", "container", "content", "entry", "form", "group", "icons", "inner", "item", "items", "js", "left",
    "link", "links", "list", "main", "media", "module", "outer", "page", "panel", "post", "posts", "primary", "right", "row", "secondary", "section", "site", "slot", "stories", "text", "title", "top", "unit", "wrap", "wrapper",
}
# Frequent words of English, German, French and Spanish.
STOP_WORDS = set(
    "a about after all also an and any are as at be been but by can could did do for from had has have he her his how i if in into is it its more most my no not of on one only or other our out"
    " over she so some such than that the their them then there these they this to up was we were what when which who will with would you your"
    " als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für habe haben hat ich ihr im in ist ja kann man mit nach nicht noch nur ob oder"
    " ohne schon sein seine sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur"
    " ai au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur"
    " un une vous y à été être"
    " al como con cuando de del desde donde el ella en entre era es esta este esto fue ha hay la las le lo los más me mi muy nada ni no nos o para pero por porque que se ser si sin sobre son su"
    " sus también te tiene todo un una uno y ya".split()
)

# Words that name what readers write, and mark it as the last word of a name too (user-comment).
READERS = {"comment", "comments", "commentlist", "replies"}
# Parts of a class name that say that a page or article has something, not that it is that.
STATES = {"has", "no", "not", "with", "without", "enabled", "disabled", "hidden", "off"}

#: A page with a lower density of stop words is in none of their languages.
FOREIGN = 0.03
#: Link density above which a block is no text, and in an article; below LONG characters a block without enough stop words stays open; densities of stop words.
LINKS, ALL_LINKS, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 0.95, 70, 200, 0.15, 0.3


@dataclass
class Block:
    text: str
    links: int
    away: bool
    article: int  # number of the article or main element it stands in, 0 if none
    prose: bool  # a paragraph or heading
    label: str = ""


def away_name(attributes: str, in_article: bool) -> bool:
    """Whether a class, id or role marks what isn't the article; names of states (no-sidebar, share-enabled) don't.

    In an article all parts of the name must speak for it, and its header is the article's own."""
    for found in NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            ordered = [p for p in re.split(r"[^a-z]+", name) if p]
            parts = set(ordered)
            if parts & STATES:
                continue
            if ordered and ordered[-1] in READERS:
                return True
            known = AWAY_NAMES - {"header"} if in_article else AWAY_NAMES
            if parts & known and not in_article:
                return True
            if parts & (known | AWAY_ALONE) and not parts - known - AWAY_ALONE - PLAIN_NAMES:
                return True
    return False


def hidden(attributes: str) -> bool:
    """Whether an element isn't shown, by its own attributes."""
    bare = QUOTED.sub('""', attributes)
    return bool(HIDDEN.search(bare) or UNSEEN.search(attributes))


def blocks_of(page: str, wrapped: bool = False) -> list[Block]:
    """The page's blocks in order, character references decoded and white space runs as one space; empty ones left out.
    With ``wrapped`` outermost forms and elements named as away are taken for wrappers of the page."""
    out: list[Block] = []
    open_: list[tuple[str, bool, int, bool]] = []  # tag, stands in something that isn't the article, article, in a wrapper
    words: list[str] = []
    links, articles, at = 0, 0, 0
    link_in = -1  # how many elements were open where the link began, -1 outside of links
    math = False  # in a formula, whose elements are parts of a line

    def end() -> None:
        nonlocal links
        text = SPACE.sub(" ", unescape("".join(words))).strip()
        if text:
            tag, away, article, _ = open_[-1] if open_ else ("", False, 0, False)
            out.append(Block(text, links, away, article, tag in PROSE))
        words.clear()
        links = 0

    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag, piece = m[2], m[0]
        if tag is None:
            if not (piece[0] == "<" and len(piece) > 1):
                words.append(piece)
                links += len(piece) if link_in >= 0 else 0
            continue
        tag = tag.lower()
        if tag in RAW:  # what it holds isn't markup
            if not m[1] and not m[3].endswith("/"):
                closed = RAW_ENDS[tag].search(page, at)
                at = closed.end() if closed else len(page)
        elif tag == "a":
            link_in = -1 if m[1] else len(open_)
        elif tag == "math" or math:
            math = not (tag == "math" and m[1])
        elif tag in INLINE:
            if tag == "br":
                words.append(" ")
        elif m[1]:
            end()
            if any(x[0] == tag for x in open_):
                while open_.pop()[0] != tag:
                    pass
                link_in = link_in if link_in <= len(open_) else -1
        else:
            end()
            if tag in VOID:
                continue
            if tag in CLOSED_BY_THE_NEXT and open_ and open_[-1][0] == tag:
                open_.pop()
                link_in = link_in if link_in <= len(open_) else -1
            _, away, article, inside = open_[-1] if open_ else ("", False, 0, False)
            if tag in ARTICLE and not article:
                articles += 1
                article = articles
            named = tag == "form" or (tag not in ("body", "html") and away_name(m[3], bool(article) and tag not in ARTICLE))
            if named and wrapped and not inside and tag in WRAPPERS:
                named, inside = False, True
            away = away or named or (tag in AWAY and tag != "form") or (tag == "header" and not article) or hidden(m[3])
            open_.append((tag, away, article, inside))
    end()
    return out


def stop_density(text: str) -> float:
    words = re.findall(r"[^\W\d_]+", text.lower())
    return sum(w in STOP_WORDS for w in words) / max(len(words), 1)


def label_blocks(blocks: list[Block]) -> list[Block]:
    """Sets each block's label to good or bad.

    A block is good if it is long and rich in stop words, bad if it is long and poor in them or made of links, and open
    if it is short or in between. In an article or main element a lack of stop words leaves it open, and so do links in
    a sentence, paragraph or heading. On a page in none of the stop words' languages length alone makes a block good.
    """
    foreign = stop_density(" ".join(b.text for b in blocks)) < FOREIGN
    for b in blocks:
        links, size = b.links / max(len(b.text), 1), len(b.text)
        stops = (STOP_LOW if size >= LONG or b.article else 0) if foreign else stop_density(b.text)
        if b.away or links > (ALL_LINKS if b.article else LINKS) and not (b.article and (b.prose or size >= LONG)):
            b.label = "bad"
        elif size >= SHORT and links <= LINKS and (stops >= STOP_HIGH or stops >= STOP_LOW and (size >= LONG or b.article)):
            b.label = "good"
        elif size >= LONG and stops < STOP_LOW and not b.article:
            b.label = "bad"
    decided = [(i, b) for i, b in enumerate(blocks) if b.label]
    before = [None] * len(blocks)
    after = [None] * len(blocks)
    for held, order in ((before, range(len(blocks))), (after, reversed(range(len(blocks))))):
        near: dict[int, tuple[int, str]] = {}
        for i in order:
            b = blocks[i]
            held[i] = near.get(b.article)
            if b.label and not (b.article and b.away):
                near[b.article] = (i, b.label)
    found = dict(decided)
    for i, b in enumerate(blocks):
        if i in found:
            continue
        sides = [x for x in (before[i], after[i]) if x]
        if not sides:
            b.label = "good" if b.article else "bad"
        else:  # the nearer side, and of two as near the good one
            b.label = min(sides, key=lambda x: (abs(x[0] - i), x[1] != "good"))[1]
    return blocks


def main_text(page: str | None) -> str:
    """The text of the good blocks. If there is none, the page may stand in a wrapper that looks like a part beside it:
    its text counts if it has an article or two good blocks at least, so that a lone notice stays out."""
    if not isinstance(page, str) or not page:
        return ""
    first = blocks_of(page)
    good = [b for b in label_blocks(first) if b.label == "good"]
    if not good and any(b.away for b in first):
        good = [b for b in label_blocks(blocks_of(page, wrapped=True)) if b.label == "good"]
        if len(good) < 2 and not any(b.article for b in good):
            good = []
    return "\n".join(b.text for b in good)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with text, the main text, and n_chars, its code points.

    Blocks are joined by one line feed in page order. A null or empty page, or one without article, has an empty
    text; broken markup is read as far as it goes; pages of any length are read whole. Columns named text or
    n_chars are replaced, others are kept; repeated rows get the same result.
    """

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None)

    return pages.withColumn("text", text(F.col(html))).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
