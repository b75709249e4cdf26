"""Main text of web pages by two passes of block rules.

The first pass cuts a page into blocks. What stands in furniture (menus, footers, forms,
comments, ...) goes; on all other blocks length, link density, the density of stop words and an
article landmark have votes. Where a page's language has no list of stop words, long blocks
without links have that vote. The second pass gives ambiguous blocks the label of their nearest
decided neighbours. One map over the pages, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from alarmloom.llm.shared import batch, blocks

# Element names, hints in class, id and role, and function words.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
HIDDEN = frozenset("head title noscript template iframe object svg canvas audio video math select option textarea button".split())
CONTAINERS = frozenset(
    "html body div section nav header footer aside form article main ul ol dl table tbody thead tfoot tr td th "
    "figure fieldset details dialog menu blockquote head noscript template iframe object svg select".split()
)
BLOCK = CONTAINERS | frozenset("p pre h1 h2 h3 h4 h5 h6 li dt dd hr address caption figcaption legend summary center".split())
FURNITURE = frozenset("nav aside footer form menu dialog fieldset".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices alert alerts newsletter subscribe subscription popup modal overlay sidebar menu "
    "nav navbar navigation breadcrumb breadcrumbs footer header masthead share sharing social related recommended "
    "recommendations comment comments disqus reply replies respond discussion reactions login signin signup search "
    "pagination pager toolbar widget widgets copyright legal complementary contentinfo alertdialog skip".split()
)
HARD_HINTS = HINTS - {"header", "alert", "alerts", "search", "legal", "menu", "navigation", "nav"}
STOP = frozenset(
    "the of and to in a is that for it was on as with be by at this are or from an have not but which you he his they "
    "la le les de des du un une et est en que qui pour dans sur pas au aux ce par plus avec il elle ne se son sa "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "el los las del y una por con no se lo su para como más al o pero sus le ya este".split()
)
LONG, SHORT = 200, 70
LINKED, ALL_LINKED = 0.2, 0.6
# Shares of stop words; the list is short, so prose has fewer of them than under longer lists.
STOP_LOW, STOP_HIGH = 0.08, 0.18
# Class words that mark a container as the article.
MARKED = re.compile(r"(main|article|post|entry|story)[-_]?(content|body|text|main)?|content[-_]?(main|body)?")

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[^a-z]+")
LETTERS = re.compile(r"[^\W\d_]+")

GOOD, BAD, SHORT_BLOCK, NEAR, HEADING, OUT = "good", "bad", "short", "near", "heading", "out"

SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class Block:
    """Text between two block-level tags."""

    __slots__ = ("pieces", "linked", "place", "heading")

    def __init__(self, place: str, heading: bool):
        self.pieces: list[str] = []
        self.linked = 0
        self.place = place
        self.heading = heading

    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _hint(name: str, attributes: str) -> str:
    """What an element says about its content: bad, good, hidden or nothing."""
    if name in HIDDEN:
        return "hidden"
    hinted, marked = "", False
    if attributes and not attributes.isspace():
        words: set[str] = set()
        for key, *values in ATTRIBUTE.findall(attributes):
            value = "".join(values)
            key = key.lower()
            if key == "hidden" or key == "aria-hidden":
                if key == "hidden" or value.lower() == "true":
                    hinted = "bad"
            else:
                spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", value)
                words.update(WORDS.split(spaced.lower()))
                marked |= key != "role" and any(MARKED.fullmatch(x) for x in value.lower().split()) or value == "main"
        if name not in ("html", "body") and words & (HARD_HINTS if name in ("article", "main") else HINTS):
            hinted = "bad"
        elif not hinted and marked and name in CONTAINERS and name not in ("html", "body"):
            hinted = "good"
    if hinted == "bad" or name in FURNITURE:
        return "bad"
    if hinted == "good" or name in ("article", "main"):
        return "good"
    return "header" if name == "header" else ""


def _place(stack: list[tuple[str, str]]) -> str:
    """The label of the innermost landmark; a header counts only outside of an article."""
    for _, hint in reversed(stack):
        if hint in ("bad", "hidden", "good"):
            return hint
        if hint == "header":
            return "" if any(h == "good" for _, h in stack) else "bad"
    return ""


def _close(stack: list[tuple[str, str]], name: str) -> None:
    """Closes the element and all in it; inline elements do not close what holds them."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if name not in CONTAINERS and stack[i][0] in CONTAINERS:
            return


def cut(html: str) -> Iterator[Block]:
    """Blocks with text, in page order."""
    stack: list[tuple[str, str]] = []
    block, at, links, size = Block("", False), 0, 0, len(html)

    def take(raw: str) -> None:
        if raw and block.place != "hidden":
            text = unescape(raw) if "&" in raw else raw
            block.pieces.append(text)
            if links:
                block.linked += len(text.strip())

    while at < size:
        m = TAG.search(html, at)
        if m is None:
            break
        take(html[at : m.start()])
        at = m.end()
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if slash:
            if name == "a":
                links = max(0, links - 1)
            _close(stack, name)
        elif name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else size
            continue
        elif name not in VOID and not attributes.endswith("/"):
            if name == "a":
                links = 1
            if name in ("p", "li", "dt", "dd", "option") or name in BLOCK:
                _close(stack, "p" if name not in ("li", "option") else name)
            stack.append((name, _hint(name, attributes)))
        place = _place(stack)
        if name in BLOCK or place != block.place:
            if block.pieces:
                yield block
            links = links if name == "a" else 0
            block = Block(place, bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"))
        elif name == "br":
            block.pieces.append(" ")
    take(html[at:])
    if block.pieces:
        yield block


def density(text: str) -> float:
    """Share of stop words among the words of a text."""
    words = LETTERS.findall(text.lower())
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def votes(text: str, block: Block, stops: float | None) -> int:
    """Votes of length, links, stop words (None: the language has no list) and landmark on a block."""
    linked = block.linked / max(1, len(text))
    out = 2 if block.place == "good" else 0
    if linked > LINKED:
        out -= 3 if linked > ALL_LINKED and len(text) >= SHORT else 2
    if len(text) < SHORT:
        return out - (1 if 0 < linked <= LINKED and not out else 0)
    if len(text) > LONG:
        out += 1 if stops is not None or block.linked else 2
    if stops is not None:
        out += 1 if stops >= STOP_HIGH else -1 if stops < STOP_LOW else 0
    return out


def named(text: str, block: Block, count: int) -> str:
    """The label that votes amount to."""
    if count >= 2 or count <= -1:
        return GOOD if count >= 2 else BAD
    if block.heading and len(text) < LONG:
        return HEADING
    return SHORT_BLOCK if len(text) < SHORT else NEAR


def labels(found: list[tuple[str, Block]]) -> list[str]:
    """First pass: each block on its own, given what is known of the whole page.

    A page whose text has hardly a stop word is in a language without a list. Where
    landmarks hold at least as much text as the good blocks outside of them, they are the
    article, which is two votes against what is outside.
    """
    own = [b.place != "bad" for _, b in found]
    stops = [density(t) if keep and len(t) >= SHORT else 0.0 for (t, _), keep in zip(found, own)]
    sizes = [len(t) if keep and len(t) >= SHORT else 0 for (t, _), keep in zip(found, own)]
    listed = sum(s * n for s, n in zip(stops, sizes)) >= STOP_LOW * sum(sizes)
    counts = [votes(t, b, s if listed else None) for (t, b), s in zip(found, stops)]
    inside = sum(len(t) for t, b in found if b.place == "good")
    outside = sum(len(t) for (t, b), keep, c in zip(found, own, counts) if keep and b.place != "good" and c >= 2)
    marked = inside > 0 and inside >= outside
    return [
        named(t, b, c - 2 if marked and b.place != "good" else c) if keep else OUT
        for (t, b), keep, c in zip(found, own, counts)
    ]


def settle(labels: list[str]) -> list[bool]:
    """Second pass: ambiguous blocks take the label of the nearest decided neighbours.

    Of two neighbours as near as each other, both must be good for a short block and
    either for a longer one; a heading follows what comes after it. Furniture goes and
    says nothing about what is beside it. On a page where nothing is decided, all that is
    not furniture stays.
    """
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for i in range(1, n):
        before[i] = i - 1 if labels[i - 1] in (GOOD, BAD) else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = i + 1 if labels[i + 1] in (GOOD, BAD) else after[i + 1]
    out = []
    for i, own in enumerate(labels):
        if own in (GOOD, BAD, OUT):
            out.append(own == GOOD)
            continue
        left = labels[before[i]] == GOOD if before[i] >= 0 else None
        right = labels[after[i]] == GOOD if after[i] < n else None
        if left is None and right is None:
            out.append(True)
        elif own == HEADING:
            out.append(bool(right))
        elif left is None or right is None:
            out.append(bool(left or right))
        elif i - before[i] != after[i] - i:
            out.append(left if i - before[i] < after[i] - i else right)
        else:
            out.append(left or right if own == NEAR else left and right)
    return out


def main_text(html: str) -> str:
    """The text of one page."""
    found = [(b.text(), b) for b in cut(html)]
    found = [(t, b) for t, b in found if t and b.place != "hidden"]
    return " ".join(t for (t, _), keep in zip(found, settle(labels(found))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of the text), one row per row of pages.

    A missing or empty page has an empty text; a very long one is read whole. Two equally
    near neighbours that disagree keep an ambiguous block unless it is short. Repeated rows
    each give a row; other columns of pages are not looked at.
    """

    def work(batches):
        for part in blocks(batches, "html"):
            texts = [main_text(h.decode("utf-8", "replace")) if h else "" for h in part.column("html").to_pylist()]
            ids, urls = part.column("page_id"), part.column("url")
            yield batch(SCHEMA, [ids.to_pylist(), urls.to_pylist(), texts, [len(t) for t in texts]])

    html = F.col("html").cast("binary").alias("html")
    return pages.select("page_id", "url", html).mapInArrow(work, "page_id bigint, url string, text string, n_chars bigint")
