"""Main text of HTML pages by two passes over text blocks.

The page is cut into blocks at block-level tags (and at two line breaks in a row). First
pass, from length, stop-word density and link density: *good* (long and dense), *bad* (links,
furniture, or prose too thin to be any), or undecided (*near*: fairly dense, *thin*: sparse but
inside an article or free of links, *short*). Second pass: an undecided block takes the label of its nearest
decided neighbours in its container; if they differ the nearer one counts, at equal distance a
near block or a heading before a good block is good and a short one bad. Where a container has
no decided block, near and article blocks are good and the others bad.

Structure is evidence too. Blocks in navigation, page headers and footers, sidebars, forms,
scripts and elements whose class, id or role names them as such are bad; a form that holds most
of the page's text is no furniture. ``article`` and ``main`` make containers: sparse blocks
inside are undecided and not bad, and if containers hold at least as much good text as the rest
of the page, the rest is bad; else they were teasers and count like the rest.

The stop words are those of German, English, Spanish, French, Italian and Portuguese. A page on
which they are less than ``SPOKEN`` of the words is in another language: there length and link
density decide alone.

Character references are decoded, white space inside a block becomes one space, and good
blocks are joined by two line feeds in page order; nothing else is dropped or cut.

Null html counts as empty and gives an empty text; so does a page without good blocks.
Malformed markup is read leniently and never raises: as in browsers, an unclosed comment, script
or style runs to the page's end; from a tag on that never closes outside quotes, tags end at the
first ``>``. Time is linear in the page's length, and a task holds one batch of pages, so a very
long page costs its own length. Repeated rows are each returned; equal pages get equal texts.
Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievetext.llm.arrow_tools import map_kept

#: Fixed element names.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("aside audio button canvas dialog footer head header iframe map menu nav noscript object script select style svg template textarea title video".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the same kind, or any block for ``p``, closes.
SELF_CLOSING = frozenset("li dt dd option tr td th".split())
#: Fixed words of class, id and role attributes that mark page furniture.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination pager paywall "
    "popup promo promotion related replies reply respond share sharing sidebar signup site-footer skip social sponsor sponsored subscribe subscription "
    "tagcloud toolbar topbar widget widgets complementary contentinfo search".split()
)
#: Words of wrappers, whose names speak of what they hold and not of themselves.
WRAPPER_WORDS = frozenset("wrap wrapper container layout grid page has no with without".split())
#: Words that mark furniture outside an article only.
OUTSIDE_WORDS = frozenset("header masthead banner".split())
STOP_WORDS = frozenset(
    "a al an and are as at au auch auf aus avec be been bei but by ce como con da dans das de del dem den der des die du e ein eine einen el elle en er es est et "
    "for from für had has have he her his i ich il im in is ist it its la las le les lo los mais mit más ne nicht no nous of on or os ou par para pas pero plus por pour "
    "qu que qui s se sein si sich sie sind son sont su sur sus t that the their they this to um un una und une uno von vous war was we were wie will with y you zu zum zur à".split()
)
SHORT, LONG, LINKED, LOW, HIGH = 70, 200, 0.5, 0.2, 0.3
#: Share of stop words from which on a page is taken to be in one of their languages.
SPOKEN = 0.05

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
#: A tag that ends at the first ``>``, quoted or not.
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_PARTS = re.compile(r"[A-Za-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    noise: bool = False
    heading: bool = False
    container: int = 0
    #: Inside a form, which makes it furniture unless most of the page is.
    form: bool = False
    text: str = ""
    label: str = ""


def _is_noise(attributes: str, container: int) -> bool:
    if not attributes:
        return False
    for _, value in _NAMED.findall(attributes):
        words = {w.lower() for w in _PARTS.findall(value)}
        if words & NOISE_WORDS - (OUTSIDE_WORDS if container else frozenset()) and not words & WRAPPER_WORDS:
            return True
    return bool(_HIDDEN.search(attributes))


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, white space collapsed, empty ones left out."""
    out: list[Block] = []
    block = Block()
    #: Open elements as (tag, noise, container), and how often each tag is open.
    stack: list[tuple[str, bool, int]] = []
    opened: dict[str, int] = {}
    noise, container, containers, links, breaks = False, 0, 0, 0, 0

    def flush() -> None:
        nonlocal block
        if block.parts and (text := " ".join("".join(block.parts).split())):
            block.text = text
            out.append(block)
        block = Block(noise=noise, container=container, heading=any(opened.get(h) for h in HEADINGS), form=bool(opened.get("form")))

    def add(text: str) -> None:
        nonlocal breaks
        if not text:
            return
        if "&" in text:
            text = html.unescape(text)
        block.parts.append(text)
        if not text.isspace():
            breaks = 0
            if links:
                block.linked += len(" ".join(text.split()))

    def close(tag: str) -> None:
        nonlocal noise, container, links
        while stack:
            name = stack.pop()[0]
            opened[name] -= 1
            links -= name == "a"
            if name == tag:
                break
        noise, container = stack[-1][1:] if stack else (False, 0)

    at, size, tag_at = 0, len(page), _TAG
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        m = tag_at.match(page, begin)
        if m is None:
            follows = page[begin + 1 : begin + 2]
            if follows.isalpha() and tag_at is _TAG and page.find(">", begin) >= 0:
                tag_at = _PLAIN_TAG  # looked to the end once; never again
                at = begin
                continue
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = end + 3 if end >= 0 else size
            elif follows in ("!", "?", "/") or follows.isalpha():
                end = page.find(">", begin)
                at = end + 1 if end >= 0 else size
            else:
                add("<")
                at = begin + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                flush()
            if opened.get(tag):
                close(tag)
                if tag in BLOCK_TAGS or noise != block.noise:
                    flush()
            continue
        if tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks == 2:
                flush()
            continue
        skipped = tag in SKIPPED_TAGS and not (tag == "header" and container)
        marked = skipped or (tag not in ("html", "body", "article", "main") and _is_noise(m[3], container)) or (tag == "article" and container > 0 and _is_noise(m[3], container))
        if tag in BLOCK_TAGS or (marked and not noise):
            flush()
        if tag in BLOCK_TAGS and opened.get("p") and any(x[0] == "p" for x in stack[-8:]):
            close("p")
        elif tag in SELF_CLOSING and stack and stack[-1][0] == tag:
            close(tag)
        if tag in VOID_TAGS or m[3].endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ("article", "main") and not noise and not container:
            containers += 1
            container = containers
        noise = noise or marked
        stack.append((tag, noise, container))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
        if tag in BLOCK_TAGS or noise != block.noise:
            flush()
    flush()
    return out


def stop_words(text: str) -> tuple[int, int]:
    """How many of a text's words are stop words, and how many words it has."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words), len(words)


def _first_pass(block: Block, spoken: bool) -> str:
    size = len(block.text)
    link = block.linked / size
    if block.noise or link > LINKED or (size < LONG and "©" in block.text and not block.container):
        return "bad"
    if size < SHORT:
        return "bad" if link > 0 and not block.container else "short"
    stops, words = stop_words(block.text)
    density = stops / words if spoken else HIGH
    if density >= HIGH and size > LONG:
        return "good"
    if density >= LOW:
        return "near"
    return "thin" if block.container or (density >= LOW / 2 and not link) else "bad"


def _second_pass(blocks: list[Block]) -> None:
    """Undecided blocks of one container take the label of their nearest decided neighbours."""
    first = [b.label for b in blocks]
    before: list[int] = []
    last = -1
    for k, label in enumerate(first):
        if label in ("good", "bad"):
            last = k
        before.append(last)
    last = len(blocks)
    for k in range(len(blocks) - 1, -1, -1):
        if first[k] in ("good", "bad"):
            last = k
            continue
        block, lo, hi = blocks[k], before[k], last
        left, right = first[lo] if lo >= 0 else None, first[hi] if hi < len(blocks) else None
        if left is None and right is None:
            block.label = "good" if block.container or first[k] == "near" else "bad"
        elif left is None or right is None or left == right:
            block.label = left or right
        elif block.heading and right == "good":
            block.label = "good"
        elif k - lo != hi - k:
            block.label = left if k - lo < hi - k else right
        else:
            block.label = "good" if first[k] == "near" or block.container else "bad"


def _size(blocks: list[Block], wanted) -> int:
    return sum(len(b.text) for b in blocks if wanted(b))


def labelled(page: str | None) -> list[Block]:
    """All blocks of a page with label good or bad."""
    blocks = blocks_of(page or "")
    in_forms = _size(blocks, lambda b: b.form and not b.noise)
    if 2 * in_forms <= _size(blocks, lambda b: not b.noise):
        for b in blocks:
            b.noise = b.noise or b.form
    counts = [stop_words(b.text) for b in blocks if not b.noise]
    spoken = sum(x for x, _ in counts) >= SPOKEN * sum(n for _, n in counts)
    by_container: dict[int, list[Block]] = {}
    for b in blocks:
        b.label = _first_pass(b, spoken)
        if not b.noise:
            by_container.setdefault(b.container, []).append(b)
    for group in by_container.values():
        _second_pass(group)
    inside, outside = (_size(blocks, lambda b: b.label == "good" and bool(b.container) == where) for where in (True, False))
    if inside and inside >= outside:
        for b in blocks:
            if not b.container:
                b.label = "bad"
    return blocks


def main_text(page: str | None) -> str:
    return "\n\n".join(b.text for b in labelled(page) if b.label == "good")


def extract(pages: DataFrame, keep: list[str], html_column: str = "html") -> DataFrame:
    """``keep`` and ``text``, the main text of each whole page."""

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([main_text(p.as_py()) for p in batch.column(0)], pa.string())]

    return map_kept(pages, keep, [F.col(html_column).cast("string")], work, "text string", 256)
