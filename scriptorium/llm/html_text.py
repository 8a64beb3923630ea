"""Main text of web pages by two-pass block rules.

A page is read as a stream of tags and text. Parts that their element, role, class
or id marks as navigation, header, footer, sidebar, notice, advert, form, comments,
script or style are left out with all they contain. What remains is cut into blocks
at block elements. The first pass classifies blocks by stop-word density, length and
link density; the second gives ambiguous blocks the class of their nearest decided
neighbours. Where a page marks its article, labels do not cross its border, which
counts as a good neighbour inside and as a bad one outside.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrays import bounded

# Elements whose content is never main text.
_DROPPED = frozenset("script style noscript template head nav footer aside form button select option textarea input iframe object embed svg canvas audio video map dialog menu datalist fieldset label".split())
# Elements that end a block.
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_CLOSES_P = _BLOCK - {"body", "html"}
# Roles of parts around the main text.
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
# Words in class or id names of parts around the main text.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|submenu|breadcrumbs?|header|masthead|topbar|banner|footer|sidebar|side-bar|aside|rail|widget|widgets|cookies?|cookie-?\w*|consent|gdpr|notice|notices|notification|alert|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|ad|ads|advert|adverts|advertisement|advertising|adsense|adbox|ad-?slot|sponsor|sponsored|promo|promos|promotion|comments?|comment-?list|respond|reply|replies|disqus|share|sharing|social|related|recommended|recommendations|tags|tag-?cloud|pagination|pager|skip-?link|toolbar|search|search-?form|form|hidden|print-?only|byline-?ads?|disclaimer|copyright|legal|toc)(?:$|[\s_-])",
    re.I,
)
# Words of such names that also hold for containers inside an article; other elements there stay whatever their name.
_NAMED_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|submenu|breadcrumbs?|sidebar|side-bar|cookies?|cookie-?\w*|consent|gdpr|notice|notices|popup|pop-up|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|ad|ads|advert|adverts|advertisement|advertising|adsense|adbox|ad-?slot|sponsor|sponsored|promo|promos|promotion|comments|comment-?list|respond|replies|disqus|share|sharing|social|related|recommended|recommendations|pagination|pager|skip-?link|toolbar|search-?form|byline-?ads?)(?:$|[\s_-])",
    re.I,
)
_CONTAINERS = frozenset("div section ul ol dl table details article center".split())
# Elements of running text, which in an article are undecided even if they are one link.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th figcaption summary address".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MAIN_NAMED = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|article-?body|post-?body|entry-?content|post-?content|article-?content|main-?content)(?:$|[\s_-])", re.I)
# Frequent function words of the languages read here.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are as with be this at by from or an not but have he she his her they we you which their has had were been will would there what all if can said do about who its into than then them these so some out up also when more no only"
    " le la les de des du un une et en est que qui dans pour par sur pas plus ne se au aux ce cette ces son sa ses il elle ils elles nous vous ou mais avec sont été être"
    " el los las del y en que por para con una uno es se no su sus al lo como más pero son fue está este esta estos"
    " der die das den dem des und ist ein eine einer eines einem einen nicht mit von zu auf für im in sich auch als an er sie es wird sind war bei aus nach oder aber wie".split()
)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'>/]+)", re.S)
_RELEVANT = re.compile(r"class|id\s*=|role|hidden|style|aria-", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"\w+")


@dataclass
class Block:
    text: str
    tag: str
    linked: int  # characters in links
    in_main: bool
    label: str = ""


@dataclass
class _Open:
    tag: str
    dropped: bool
    main: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    dropped: int = 0
    mains: int = 0
    links: int = 0
    has_main: bool = False
    open_tags: Counter = field(default_factory=Counter)

    def end_block(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                tag = next((x.tag for x in reversed(self.stack) if x.tag in _BLOCK), "body")
                self.blocks.append(Block(text, tag, min(self.linked, len(text)), self.mains > 0))
            self.parts, self.linked = [], 0

    def say(self, text: str) -> None:
        if text and not self.dropped:
            self.parts.append(text)
            if self.links:
                self.linked += len(text.strip())

    def pop(self) -> None:
        x = self.stack.pop()
        self.open_tags[x.tag] -= 1
        self.dropped -= x.dropped
        self.mains -= x.main
        self.links -= x.tag == "a"

    def open(self, tag: str, attributes: str, closed: bool) -> None:
        if tag in _BLOCK:
            self.end_block()
            if tag in _CLOSES_P and self.open_tags["p"]:
                self.close("p")
            if tag == "li" and self.open_tags["li"]:
                self.close_inside("li", ("ul", "ol", "menu", "dir"))
        elif tag == "br":
            self.say(" ")
        if tag in _VOID or closed and tag not in _BLOCK:
            return
        dropped, main = self.kind(tag, attributes)
        if main and not self.dropped:
            self.has_main = True
        self.stack.append(_Open(tag, dropped, main))
        self.open_tags[tag] += 1
        self.dropped += dropped
        self.mains += main
        self.links += tag == "a"

    def kind(self, tag: str, attributes: str) -> tuple[bool, bool]:
        """(dropped, marks the article) of an element."""
        if tag in _DROPPED:
            return True, False
        inside = self.mains > 0
        if tag == "header":  # that of an article holds its title
            return not inside, False
        main = tag in ("article", "main")
        if attributes and _RELEVANT.search(attributes):
            seen = {(m[1] or m[5]).lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            name = f"{seen.get('class', '')} {seen.get('id', '')}"
            if "hidden" in seen or seen.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(seen.get("style", "")):
                return True, False
            role = seen.get("role", "").lower()
            if role in _ROLES:
                return True, False
            if inside:
                named = tag in _CONTAINERS and _NAMED_INSIDE.search(name)
            else:
                named = tag not in ("html", "body", "main") and _NAMED.search(name) and not (main and not re.search(r"comment|ad|promo|related", name, re.I))
            if named:
                return True, False
            main = main or role in ("main", "article") or bool(_MAIN_NAMED.search(name))
        return False, main

    def close_inside(self, tag: str, walls: tuple[str, ...]) -> None:
        for x in reversed(self.stack):
            if x.tag in walls:
                return
            if x.tag == tag:
                self.close(tag)
                return

    def close(self, tag: str) -> None:
        if tag in _BLOCK:
            self.end_block()
        if not self.open_tags[tag]:
            return
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i].tag == tag), None)
        if at is None or tag not in _BLOCK and any(x.tag in ("article", "main", "body", "table", "td", "div", "section") for x in self.stack[at + 1 :]):
            return
        while len(self.stack) > at:
            self.pop()


def blocks_of(page: str) -> tuple[list[Block], bool]:
    """Blocks outside dropped parts, in page order, and whether the page marks its article."""
    reader, at, n = _Reader(), 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            reader.say(page[at:])
            break
        if m.start() > at:
            reader.say(page[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            reader.say(html.escape(m[0][9:].removesuffix("]]>")))
        if not (m[2] or m[5]):
            continue
        # A tag whose quotes do not match ends at its first bracket.
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        tag = tag.lower()
        if closing:
            reader.close(tag)
            continue
        closed = attributes.endswith("/")
        if tag in _RAW and not closed:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else (n if tag in ("script", "style") else at)
            continue
        reader.open(tag, attributes, closed)
    reader.end_block()
    return reader.blocks, reader.has_main


def first_label(b: Block, short: int, long: int, low: float, high: float, max_links: float) -> str:
    """Label of a block by its own figures: good and bad are decided, all others are for the second pass."""
    found = [w.lower() for w in _WORD.findall(b.text)]
    density = sum(w in STOP_WORDS for w in found) / max(1, len(found))
    if b.linked > max_links * len(b.text):
        return "ambiguous" if b.in_main and b.tag in _RUNNING else "bad"
    if not b.in_main and b.text.startswith(("\xa9", "(c) ")):
        return "bad"
    if b.tag in _HEADINGS:
        return "heading"
    if len(b.text) < short:
        return "bad" if b.linked and not b.in_main else "short"
    if density >= high:
        return "good" if len(b.text) > long else "neargood"
    return "neargood" if density >= low else "ambiguous"


def neighbours(blocks: list[Block], decided: list[str], edges: tuple[str, str]) -> list[str]:
    """Label of the nearest decided block before each, on its own side of the article's border; edges: at the border, outside and inside."""
    out, last, side = [], "", None
    for b, label in zip(blocks, decided):
        if b.in_main != side:
            side, last = b.in_main, edges[b.in_main]
        out.append(last)
        if label in ("good", "bad"):
            last = label
    return out


def classify(blocks: list[Block], has_main: bool, short: int = 60, long: int = 180, low: float = 0.2, high: float = 0.3, max_links: float = 0.35) -> None:
    """Labels blocks good or bad: first by their own figures, then undecided ones by their nearest decided neighbours.

    Labels do not cross the border of a marked article. The border counts as bad for
    blocks outside and as good for those inside, which go only between two bad ones.
    Headings come last and have the label of the text below them.
    """
    decided = [first_label(b, short, long, low, high, max_links) for b in blocks]
    edges = ("bad", "good")
    before = neighbours(blocks, decided, edges)
    after = neighbours(blocks[::-1], decided[::-1], edges)[::-1]
    none_good = "good" not in decided
    for b, label, above, below in zip(blocks, decided, before, after):
        near = (above, below)
        if label in ("good", "bad"):
            good = label == "good"
        elif label == "heading":
            b.label = ""
            continue
        elif b.in_main:
            good = label == "neargood" or "good" in near
        elif has_main:
            good = "good" in near
        elif label == "neargood":
            good = "good" in near or none_good
        else:
            good = above == below == "good" or "good" in near and b.tag in ("p", "li", "blockquote", "td", "pre")
        b.label = "good" if good else "bad"
    below = neighbours(blocks[::-1], [b.label for b in blocks[::-1]], edges)[::-1]
    for b, label, above, text in zip(blocks, decided, before, below):
        if label == "heading":
            b.label = "good" if text == "good" or b.in_main and above == "good" or none_good and not has_main and len(blocks) > 1 else "bad"


def main_text(page: str | None) -> str:
    """Text of the good blocks, one line each; empty if none."""
    blocks, has_main = blocks_of(page or "")
    classify(blocks, has_main and any(b.in_main for b in blocks))
    return "\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty pages have an empty text; null ids and urls and repeated rows are
    kept; an empty table gives no rows. Only page_id, url and html are read. Pages are
    read whole, whatever their length, and malformed ones as far as they go.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "html"):
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
