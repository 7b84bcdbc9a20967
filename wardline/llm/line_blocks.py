"""Main text of web pages by line-block distribution.

A page is stripped of its markup and becomes lines, one per block element. What is no article by its element, role or name (menus, headers, adverts,
comments ...) leaves an empty line, and so does what is mostly links. Over windows of ``WINDOW`` lines the text lengths are summed. Where the sums surge above a threshold
a text begins; it ends where they dive to nothing; what lies between is kept, short lines included. Pages that mark their article, or else
their main part, need no threshold: lines outside it are empty lines, and the surge is its first word. On other pages the threshold is ``SURGE`` characters, or the
greatest sum where no window has as many, and groups of lines that are apart in the page's layout count as apart here.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, tidied

WINDOW, SURGE = 3, 86
#: A group of lines on an unmarked page is text beside the greatest group from this share of its length on.
SHARE = 0.2
BATCH_CHARS = 4_000_000

#: Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav noscript ol optgroup option p pre search section select summary table tbody tfoot thead tr ul caption template".split())
HOLDERS = frozenset("article aside body center div dl fieldset footer form header main nav ol section table td ul".split())
#: What a new element of this name ends, if it is open inside the named holders.
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")),
        "th": ("td th", ("tr", "table")), "option": ("option", ("select", "datalist")), "optgroup": ("option optgroup", ("select",))}
#: Never text, wherever they stand.
NO_TEXT = frozenset("head noscript template svg canvas audio video object map button select datalist dialog label".split())
#: Beside the text, unless the article stands inside.
BESIDE = frozenset("nav footer aside form menu search".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar".split())
APART_ROLES = frozenset("dialog alert alertdialog status tooltip".split())
#: Words in class or id: parts that never hold the article, and parts of the page's frame.
APART_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored sponsors promo promos promotion promoted comment comments commentlist disqus "
    "discussion replies respond responses related recommended recommendations trending popular newsletter subscribe subscription signup cookie cookies consent gdpr popup modal "
    "share sharing social hidden taboola outbrain pagination pager breadcrumb breadcrumbs".split())
BESIDE_WORDS = frozenset(
    "nav navbar navigation navi menu menus topbar sidebar sidebars sidenav aside rail widget widgets masthead banner notice notices notification alert footer foot copyright toolbar login signin search "
    "skip overlay".split())
TEXT_WORDS = frozenset("article entry post story content".split())
NOT_WORDS = frozenset("has no with without".split())

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]*))*+)(?:>|\Z)"  # start or end of an element
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_NAMED = re.compile(r"class|id|role|hidden|style|itemprop", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def _nature(name: str, attributes: str, in_text: bool) -> tuple[str, str]:
    """(is it ``apart`` or ``beside`` the text, or empty; does it mark the ``article`` or the ``main`` part, or empty)."""
    if name in NO_TEXT:
        return "apart", ""
    part = name if name in ("article", "main") else ""
    found = "beside" if name in BESIDE or name == "header" and not in_text else ""
    if not _NAMED.search(attributes):
        return found, part
    values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role = values.get("role", "").strip().lower()
    if values.get("itemprop", "").lower() == "articlebody":
        part = "article"
    elif role == "main":
        part = part or "main"
    if "hidden" in values and values["hidden"].lower() != "until-found" or values.get("aria-hidden", "").lower() == "true" or _NO_DISPLAY.search(values.get("style", "")) or role in APART_ROLES:
        return "apart", part
    if role in BESIDE_ROLES:
        found = "beside"
    if name not in ("html", "body", "main"):
        for token in f"{values.get('class', '')} {values.get('id', '')}".split():
            words = [w.lower() for w in _WORDS.findall(token)]
            words += map("".join, zip(words, words[1:]))  # side-bar, sideBar
            if not NOT_WORDS.isdisjoint(words):
                continue
            if not APART_WORDS.isdisjoint(words):
                return "apart", part
            if not BESIDE_WORDS.isdisjoint(words) or "header" in words and not in_text and TEXT_WORDS.isdisjoint(words):
                found = "beside"
    return found, part


class _Page:
    """The lines of a page: text, length of what is no link (0 if that is the lesser part), what they are in, and which layout group holds them."""

    def __init__(self, source: str):
        self.lines: list[tuple[str, int, int, bool, bool, int, int]] = []  # text, weight, length, in article, in main, beside-element, holder
        self.holder_of, self.forms = [0], set()  # holder ids to the holder around; beside-elements that are forms
        self.stack: list[tuple[str, str, str, int, int]] = []  # name, nature, part, holder, beside-element
        self.apart = self.articles = self.mains = self.links = self.holder = self.beside = self.count = 0
        self.open: dict[str, int] = {}  # how many elements of a name are open
        self.pieces: list[str] = []
        self.size = self.linked = 0
        self._read(source)
        self._cut()

    def _read(self, source: str) -> None:
        at = 0
        while True:
            tag = _TAG.search(source, at)
            if tag is None:
                break
            if tag.start() > at and not self.apart:
                self._text(source[at:tag.start()])
            at = tag.end()
            name = tag[2].lower() if tag[2] else ""
            if not name:
                continue
            if tag[1]:
                self._end(name)
                continue
            self._start(name, tag[3])
            if name in RAW:
                stop = _RAW_ENDS[name].search(source, at)
                at = stop.start() if stop else len(source)
        if at < len(source) and not self.apart:
            self._text(source[at:])

    def _text(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self.pieces.append(text)
        n = len(text)
        self.size += n
        if self.links:
            self.linked += n

    def _cut(self) -> None:
        """End the line."""
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                weight = len(text) if self.linked * 2 <= self.size else 0
                self.lines.append((text, weight, len(text), self.articles > 0, self.mains > 0, self.beside, self.holder))
            self.pieces, self.size, self.linked = [], 0, 0

    def _gap(self) -> None:
        self.lines.append(("", 0, 0, False, False, 0, self.holder))

    def _start(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._cut()
            if self.open.get("p") and name not in ("option", "optgroup"):
                self._close("p", HOLDERS)
        elif name in ("br", "td", "th") and not self.apart:
            self.pieces.append(" ")
        if name in ENDS:
            names, inside = ENDS[name]
            for other in names.split():
                if self.open.get(other):
                    self._close(other, inside)
        if name in VOID:
            return
        if name in RAW:
            nature, part = "apart", ""
        else:
            nature, part = _nature(name, attributes, self.articles > 0 or self.mains > 0)
        if part and not self.apart and self.beside:
            # the article cannot be beside itself: what is open around it is the page's frame
            self.beside = 0
            self.stack = [(n, "" if kind == "beside" else kind, p, h, 0) for n, kind, p, h, _ in self.stack]
        if nature and not self.apart:
            self._cut()
            self._gap()
        self.stack.append((name, nature, part, self.holder, self.beside))
        self.open[name] = self.open.get(name, 0) + 1
        if nature == "apart":
            self.apart += 1
        elif nature == "beside" and not self.beside:
            self.count += 1
            self.beside = self.count
            if name == "form":
                self.forms.add(self.count)
        self.articles += part == "article"
        self.mains += part == "main"
        self.links += name == "a"
        if name in HOLDERS:
            self.holder_of.append(self.holder)
            self.holder = len(self.holder_of) - 1

    def _pop(self) -> None:
        name, nature, part, holder, beside = self.stack.pop()
        self.open[name] -= 1
        if nature or part or name in BLOCK:
            self._cut()
        if nature == "apart":
            self.apart -= 1
        self.articles -= part == "article"
        self.mains -= part == "main"
        self.links -= name == "a"
        self.holder, self.beside = holder, beside
        if nature and not self.apart:
            self._gap()

    def _close(self, name: str, inside: frozenset[str] | tuple[str, ...]) -> None:
        """End the innermost ``name`` and all in it, unless one of ``inside`` is open within."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k][0] in inside:
                return

    def _end(self, name: str) -> None:
        if name in BLOCK:
            self._cut()
        if self.open.get(name):
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def kept(self) -> list[str]:
        lines = self._framed()
        if any(x[2] and x[3] for x in lines):
            return _between([(x[0], x[2] if x[3] else 0) for x in lines], 0)
        if any(x[2] and x[4] for x in lines):
            return _between([(x[0], x[2] if x[4] else 0) for x in lines], 0)
        groups = list(self._groups(lines))
        peaks = [max(_sums([w for _, w in g])) for g in groups]
        least = min(SURGE, max(peaks, default=0) - 1)
        totals = [sum(w for _, w in g) if p > least else 0 for g, p in zip(groups, peaks)]
        most = max(totals, default=0)
        return [t for g, total in zip(groups, totals) if total and total >= SHARE * most for t in _between(g, least)]

    def _framed(self) -> list[tuple[str, int, int, bool, bool, int, int]]:
        """The lines, those beside the text emptied. A form that holds most of the page is its frame."""
        whole, own = 0, {}
        for line in self.lines:
            whole += line[2]
            if line[5]:
                own[line[5]] = own.get(line[5], 0) + line[2]
        frames = {0} | {b for b in self.forms if 2 * own.get(b, 0) > whole}
        return [x if x[5] in frames else ("", 0, 0, False, False, 0, x[6]) for x in self.lines]

    def _groups(self, lines) -> Iterator[list[tuple[str, int]]]:
        """Lines by the part of the layout that holds them: the children of the innermost holder of all; runs of single lines are one group."""
        texts = [x for x in lines if x[2]]
        if not texts:
            return
        depth = [0] * len(self.holder_of)
        for k in range(1, len(depth)):
            depth[k] = depth[self.holder_of[k]] + 1
        common = texts[0][6]
        for line in texts:
            other = line[6]
            while other != common:
                if depth[other] >= depth[common]:
                    other = self.holder_of[other]
                else:
                    common = self.holder_of[common]
        part = list(range(len(depth)))  # the child of ``common`` above each holder
        for k in range(1, len(depth)):
            if k != common and depth[k] > depth[common] + 1:
                part[k] = part[self.holder_of[k]]
        sizes: dict[int, int] = {}
        for line in texts:
            sizes[part[line[6]]] = sizes.get(part[line[6]], 0) + 1
        group, last = [], None
        for line in lines:
            own = part[line[6]]
            own = own if line[2] and own != common and sizes[own] > 1 else None if line[2] else last
            if group and own != last:
                yield group
                group = []
            last = own
            group.append((line[0], line[1]))
        yield group


def _sums(weights: list[int]) -> list[int]:
    """The sum of each line's weight and of the next WINDOW - 1."""
    out, total = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + WINDOW] if i + WINDOW < len(weights) else 0)
        out[i] = total
    return out


def _between(lines: list[tuple[str, int]], least: int) -> list[str]:
    """The texts from a surge above ``least`` to the dive after it. With a threshold of 0 only lines of weight count, else all between."""
    sums, out = _sums([w for _, w in lines]), []
    start, risen = 0, False
    for i in range(len(lines) + 1):
        if i < len(lines) and sums[i] > 0:
            risen = risen or sums[i] > least
            continue
        if risen:
            stretch = lines[start:i]
            first = next(k for k, x in enumerate(stretch) if x[1])
            out += [t for t, w in stretch[first:] if t and (w or least)]
        start, risen = i + 1, False
    return out


def main_text(source: str | None) -> str:
    """The blocks of a page's article, one a line; empty if there are none."""
    return "\n".join(_Page(source).kept()) if source else ""


def _extract(carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(carried)
            sizes = [len(s) if s is not None else 0 for s in sources.to_pylist()]
            for a, b in slices(sizes, BATCH_CHARS):
                texts = [main_text(s) for s in sources.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(x).slice(a, b - a) for x in range(carried)), pa.array(texts, pa.string())], names=[*batch.schema.names[:carried], "text"])

    return run


def extracted(pages: DataFrame, source: Column, kept: dict[str, Column]) -> DataFrame:
    """Per row what ``kept`` names, and ``text``, the main text of the HTML in ``source``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by line feeds in page order. A null or empty page, and one without
    text, gives an empty text. Unclosed and misplaced tags, cut-off pages and plain text are read as browsers do, more or less; a page is one task's work. Rows stand alone:
    repeated ones stay, null ids too; an empty table gives no rows. Columns not named are not read.
    """
    chosen = pages.select(*(c.alias(f"k{i}") for i, c in enumerate(kept.values())), source.cast("string").alias("source"))
    types = "".join(f"k{i} {f.dataType.simpleString()}, " for i, f in enumerate(chosen.schema.fields[:-1]))
    return chosen.mapInArrow(tidied(_extract(len(kept))), f"{types}text string").toDF(*kept, "text")
