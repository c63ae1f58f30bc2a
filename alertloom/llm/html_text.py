"""Operator 10: main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block. What stands in menus, headers, footers, sidebars,
notices, adverts, forms, scripts and reader comments leaves empty lines. Text lengths without links are summed over
sliding windows of lines: a region is a run of windows that don't dive to zero. The densest region is the main text and gives the
page's own surge threshold, half of its mean length of a line. The box around it (its article and main elements, or else
the innermost container with most of it) keeps all its lines under a window with text; outside it, a region is
text if a window surges above the threshold.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 3
#: An element with a furniture name that may be part of the text is a menu or a list of teasers if links hold more of it than this.
LINKED_SHARE = 0.6
#: A box inside an article with one furniture word in its class is furniture below this many characters.
SHORT = 80

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style|noscript|textarea|title|iframe|xmp)"
    r"(?=[\s/>])(?:[^>\"'/]|/(?!>)|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[a-z/][^<>]*\Z",
    re.I | re.S,
)
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_EMBEDDED = frozenset("template svg math object canvas audio video select".split())
#: What the next of its kind ends, as its closing tag may be left out.
_PEERS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
_NOT_TEXT = frozenset("nav footer aside form menu dialog button label fieldset search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup login sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager footer masthead topbar toolbar comment comments respond replies disqus share sharing social related "
    "recommended recommendations widget widgets skip disclaimer paywall".split()
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BARE = re.compile(r"=\s*[^\s\"'>]+\Z")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CONTAINERS = frozenset("div section article main td center".split())
_HREF = re.compile(r"(?:^|[\s\"'/])href\s*=", re.I)
_MAIN = frozenset(("article", "main"))
_FORMS = frozenset(("form", "fieldset", "search"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BOXES = frozenset(("div", "section", "ul"))


def _kind(name: str, attrs: str, in_main: bool) -> str:
    """Why an element may be page furniture: tag, form, hidden, named (a class or id of such words only, or two of
    them), part (one such word beside others) or part of id; empty if nothing says so."""
    if name in _FORMS:
        return "form"
    if name in _NOT_TEXT or (name == "header" and not in_main):
        return "tag"
    if name in _MAIN or name in ("body", "html") or not attrs:
        return ""
    values: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        values.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    role = values.get("role", "").lower()
    if role in _ROLES:
        return "form" if role in _FORMS else "tag"
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return "hidden"
    kind = ""
    for what in ("id", "class"):
        if what == "id" and name in _HEADINGS:  # an anchor made of the heading's own words
            continue
        for value in values.get(what, "").split():
            parts = [x.lower() in _NAMES for x in _PART.findall(value)]
            if parts and (all(parts) or sum(parts) > 1):
                return "named"
            if any(parts):
                kind = "part" if what == "class" else "part of id"
    return kind


class _Weights:
    """Running sums over the tokens of a page: its text, the text in links and in main elements, and main elements."""

    def __init__(self, page: str, tokens: list[re.Match], ends: dict[int, tuple[int, bool]]) -> None:
        self.text, self.linked, self.within, self.mains = [0], [0], [0], [0]
        at = main = link_end = 0
        for i, m in enumerate(tokens):
            n = len(page[at : m.start()].strip())
            at = m.end()
            name = (m["name"] or "").lower()
            self.text.append(self.text[-1] + n)
            self.linked.append(self.linked[-1] + (n if i <= link_end else 0))
            self.within.append(self.within[-1] + (n if main else 0))
            self.mains.append(self.mains[-1] + (name in _MAIN and not m["close"]))
            if name in _MAIN:
                main = max(0, main - 1) if m["close"] else main + 1
            elif name == "a" and not m["close"] and ends.get(i, (i, False))[1] and _HREF.search(m["attrs"]):
                link_end = ends[i][0]
        self.all = self.text[-1] + len(page[at:].strip())
        self.all_within = self.within[-1] + (len(page[at:].strip()) if main else 0)

    def is_furniture(self, i: int, stop: int, name: str, kind: str, main: int) -> bool:
        """Whether the element from token i to before token stop is furniture, by what it holds."""
        last = stop >= len(self.text)
        stop = min(stop, len(self.text) - 1)
        text = (self.all if last else self.text[stop]) - self.text[i + 1]
        within = (self.all_within if last else self.within[stop]) - self.within[i + 1]
        linked = self.linked[stop] - self.linked[i + 1]
        in_links = linked > LINKED_SHARE * text
        named = kind in ("named", "part", "part of id")
        if self.mains[stop] > self.mains[i + 1]:  # holds main elements, such as teasers or the article itself
            if kind == "form" or within > (0.9 if kind == "named" else 0.5) * self.all_within:
                return False
            return in_links or kind not in ("part", "part of id")
        if self.mains[-1] == main and (named or kind == "form"):  # no other main element
            if text > (0.9 if kind == "named" else 0.5) * self.all:
                return False
        if kind in ("part", "part of id") and (main or name == "p" or name in _HEADINGS):
            return in_links or (kind == "part" and name in _BOXES and text < SHORT)
        return True


def _is_empty(m: re.Match) -> bool:
    """Whether a tag opens nothing: void, or closed by a slash that ends no unquoted value."""
    return m["name"].lower() in _VOID or (m["attrs"].endswith("/") and not _BARE.search(m["attrs"]))


def _elements(tokens: list[re.Match]) -> dict[int, tuple[int, bool]]:
    """Index of each opening tag -> index of the token that ends it, and whether that is its own closing tag.

    The closing tag of a block also ends all that was left open inside it, a block ends an open paragraph.
    What nothing ends but the page or its body is left out.
    """
    blocks: list[tuple[str, int, list[str]]] = [("", -1, [])]  # name, index, inline elements opened inside
    depth: dict[str, int] = {}
    inline: dict[str, list[int]] = {}
    ends = {}

    def end_block(i: int, own: bool) -> None:
        name, at, inside = blocks.pop()
        depth[name] -= 1
        ends[at] = (i, own)
        if not own:
            blocks[-1][2].extend(inside)
            return
        for n in inside:
            while inline[n] and inline[n][-1] > at:
                ends[inline[n].pop()] = (i, False)

    for i, m in enumerate(tokens):
        name = (m["name"] or "").lower()
        if not name or name in ("body", "html"):
            continue
        if m["close"]:
            if name not in _BLOCKS:
                if inline.get(name):
                    ends[inline[name].pop()] = (i, True)
            elif depth.get(name):
                while blocks[-1][0] != name:
                    end_block(i, False)
                end_block(i, True)
            continue
        if name in _BLOCKS:
            while blocks[-1][0] == "p" or blocks[-1][0] in _PEERS.get(name, ()):
                end_block(i, False)
        if _is_empty(m):
            continue
        if name in _BLOCKS:
            blocks.append((name, i, []))
            depth[name] = depth.get(name, 0) + 1
        else:
            inline.setdefault(name, []).append(i)
            blocks[-1][2].append(name)
    return ends


def _skip_end(i: int, name: str, tokens: list[re.Match], ends: dict[int, tuple[int, bool]]) -> int:
    """Index of the token after a piece of page furniture. One that is never closed ends with its parent or
    at the next main element; an inline one, or one without a parent, at the next block."""
    end, own = ends.get(i, (len(tokens), False))
    if own:
        return end + 1
    short = name not in _BLOCKS or i not in ends
    for j in range(i + 1, end):
        other = (tokens[j]["name"] or "").lower()
        if (other in _MAIN and not tokens[j]["close"]) or (short and other in _BLOCKS):
            return j
    return end


class Line(NamedTuple):
    """Text of a block, whether it is in a main element, its characters in links, the innermost box (a container's
    token, -1 for the page) and whether it is a heading. Page furniture is lines without text."""

    text: str
    inside: bool = False
    linked: int = 0
    box: int = -1
    heading: bool = False


def text_lines(page: str) -> tuple[list[Line], dict[int, int], dict[int, int]]:
    """Lines of a page, box -> the box around it, and box -> the token that ends it."""
    tokens = list(_TOKEN.finditer(page))
    ends = _elements(tokens)
    weights = _Weights(page, tokens, ends)
    lines: list[Line] = []
    parts: list[str] = []
    around: dict[int, int] = {}
    until = {-1: len(tokens) + 1}
    box = heading_end = link_end = line_box = -1
    open_link = in_heading = False
    linked = main = 0

    def close_line() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                lines.append(Line(text, main > 0, linked, line_box, in_heading))
            parts, linked = [], 0

    at, i = 0, 0
    while i <= len(tokens):
        m = tokens[i] if i < len(tokens) else None
        piece = page[at : m.start() if m else len(page)]
        if piece:
            if not parts:
                while until[box] < i:
                    box = around[box]
                line_box, in_heading = box, i <= heading_end
            piece = entities.unescape(piece)
            parts.append(piece)
            if open_link or i <= link_end:
                linked += len(" ".join(piece.split()))
        if m is None:
            break
        at, i = m.end(), i + 1
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            open_link = False
        if m["close"]:
            if name in _BLOCKS:
                close_line()
                if name in _MAIN:
                    main = max(0, main - 1)
            elif name == "a":
                open_link = False
            continue
        if _is_empty(m):
            if name == "br":
                parts.append(" ")
            elif name in _BLOCKS:
                close_line()
            continue
        embedded = name in _EMBEDDED
        kind = "" if embedded else _kind(name, m["attrs"], main > 0)
        stop = _skip_end(i - 1, name, tokens, ends) if embedded or kind else i
        if embedded or (kind and weights.is_furniture(i - 1, stop, name, kind, main)):
            if name in _BLOCKS:
                close_line()
            own = ends.get(i - 1, (0, False))[1]
            i = stop
            at = tokens[i - 1].end() if own else tokens[i].start() if i < len(tokens) else len(page)
            if not main and not embedded:
                lines.extend([Line("")] * WINDOW)
            continue
        if name in _BLOCKS:
            close_line()
            if name in _MAIN:
                main += 1
            if name in _CONTAINERS:
                while until[box] < i - 1:
                    box = around[box]
                around[i - 1] = box
                until[i - 1] = ends.get(i - 1, (len(tokens) + 1, False))[0]
                box = i - 1
            elif name in _HEADINGS:
                heading_end = ends.get(i - 1, (i, False))[0]
        elif name == "a" and _HREF.search(m["attrs"]):
            end, own = ends.get(i - 1, (0, False))
            if own:
                link_end = end
            else:  # ends at the next block
                open_link = True
    close_line()
    return lines, around, until


def _regions(sums: list[int]) -> list[tuple[int, int]]:
    """Runs of lines that a window with text covers: from where the sums surge from zero to where they dive to it."""
    found: list[tuple[int, int]] = []
    for i, s in enumerate(sums):
        if s and found and i <= found[-1][1] - WINDOW + 1:
            found[-1] = (found[-1][0], i + WINDOW)
        elif s:
            found.append((i, i + WINDOW))
    return found


def main_text(page: str | None) -> str:
    """The text between the surges and dives of the line-block distribution."""
    lines, around, until = text_lines(page or "")
    lengths = [max(0, len(x.text) - x.linked) for x in lines]
    if not any(lengths):  # all the text there is stands in links
        lengths = [len(x.text) for x in lines]
    sums = [sum(lengths[max(i, 0) : i + WINDOW]) for i in range(1 - WINDOW, len(lengths))]  # windows that begin before the page, too
    regions = [(max(a - WINDOW + 1, 0), min(b - WINDOW + 1, len(lines))) for a, b in _regions(sums)]
    if not regions:
        return ""
    totals = [sum(lengths[a:b]) for a, b in regions]
    most = max(totals)
    seed = range(*regions[totals.index(most)])
    surge = most / sum(lengths[i] > 0 for i in seed) / 2

    # the box around the densest region: article and main elements, or the innermost container with most of it
    box = -1
    in_main = 2 * sum(lengths[i] for i in seed if lines[i].inside) > most
    if not in_main:
        held = dict.fromkeys([*around, -1], 0)
        for i in seed:
            held[lines[i].box] += lengths[i]
        for at in sorted(around, reverse=True):
            held[around[at]] += held[at]
        box = max(at for at, n in held.items() if 2 * n > most)
    above = {-1} if box >= 0 else set()  # the containers around the box: what stands in them directly belongs to its text
    at = around.get(box, -1)
    while at >= 0:
        above.add(at)
        at = around[at]

    def in_box(x: Line) -> bool:
        if in_main:
            return x.inside
        if x.box in above:
            return x.heading or x.box >= 0
        return box <= x.box < until[box] if box >= 0 else x.box == -1

    kept = []
    for a, b in regions:
        dense = any(sum(lengths[i : min(i + WINDOW, b)]) >= surge for i in range(a, b))
        for x, n in zip(lines[a:b], lengths[a:b], strict=True):
            if x.text and (x.inside or in_box(x) or (n and dense and not in_main)):
                kept.append(x.text)
    return "\n".join(kept)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every page.

    Null and empty pages give an empty text. Null keys and repeated rows stay, an empty table gives no
    rows, other columns are left out. Pages are parsed whole, one by one; nothing is shuffled.
    """

    @F.pandas_udf("string")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(main_text, na_action=None).astype("object")

    return pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), parse(F.coalesce(F.col(html), F.lit(""))).alias("text")
    ).withColumn("n_chars", F.length("text").cast("long"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
