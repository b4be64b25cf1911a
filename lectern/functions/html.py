"""Web pages to text: markup and furniture dropped, blocks kept apart, entities decoded; and the densest container.

A page is read once, from mark to mark, into one string of characters and line ends, with the places at which containers
begin and end in it. Its text is then words and the gaps between them: a gap is a blank, or one or two line ends if it
holds any. The length of a container's text follows from sums over the gaps before its two places, so that all containers
of a page, however nested, cost a bisection each, and the text of the chosen one alone is put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import pieces

#: Classes of blocks that are no text of the author; elements that end a block, that begin or end a part of
#: the page, that may hold the article, best last; the share of a text that a closer container keeps; named references.
FURNITURE = re.compile(r"subscription-widget|paywall-jump|button-wrapper|captioned-button-wrap")
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote div figure figcaption tr pre".split())
SECTIONS = frozenset("nav header footer aside main section article ul ol dl table".split())
CONTAINERS = ("article", "main", "section", "div")
KEEP_SHARE = 0.8
NAMED = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "amp": "&"}
PAGES = "page_id long, text string, container string"
_MARK = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)?([^>]*)>")
_CLASS = re.compile(r"class\s*=\s*\"([^\"]*)\"", re.IGNORECASE)
_NUMBER = re.compile(r"&#(?:([0-9]+)|[xX]([0-9a-fA-F]+));")
_NAME = re.compile(f"&({'|'.join(NAMED)});")
_GAP = re.compile(r"[\s\ufeff]+")
_BLANKS = re.compile(r"[ \t\xa0]+")


def decode(text: str) -> str:
    """Numeric references first, then the named ones; references to no character vanish."""

    def of(m: re.Match) -> str:
        code = int(m[1]) if m[1] else int(m[2], 16)
        return chr(code) if 0 < code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else ""

    return _NAME.sub(lambda m: NAMED[m[1]], _NUMBER.sub(of, text)) if "&" in text else text


def class_of(attributes: str) -> str:
    m = _CLASS.search(attributes)
    return m[1] if m else ""


@dataclass
class Page:
    """Characters and line ends of a page, and (tag, class, from, to) of each closed container by tag and place."""

    raw: str = ""
    held: list[tuple[str, str, int, int]] = field(default_factory=list)

    @cached_property
    def gaps(self) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Where gaps begin and end, what stands for them in the text, and how much shorter the gaps before each make it."""
        found = [(m.start(), m.end(), "\n" * min(m[0].count("\n"), 2) or _BLANKS.sub(" ", m[0])) for m in _GAP.finditer(self.raw)]
        begin, end = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
        return begin, end, [x[2] for x in found], np.concatenate([[0], np.cumsum(end - begin - np.array([len(x[2]) for x in found], np.int64))])

    def inner(self, low: int, high: int) -> tuple[int, int, int, int]:
        """The places between which the text of a part lies, and the first and last gap inside."""
        begin, end, _, _ = self.gaps
        i, j = int(np.searchsorted(end, low, "right")), int(np.searchsorted(begin, high))
        if i < len(begin) and begin[i] <= low:
            low, i = int(end[i]), i + 1
        if j and end[j - 1] >= high:
            high, j = int(begin[j - 1]), j - 1
        return low, high, i, j

    def length(self, low: int, high: int) -> int:
        low, high, i, j = self.inner(low, high)
        return max(high - low - int(self.gaps[3][j] - self.gaps[3][i]), 0) if high > low else 0

    def text(self, low: int, high: int) -> str:
        low, high, i, j = self.inner(low, high)
        if high <= low:
            return ""
        begin, end, signs, _ = self.gaps
        words = [self.raw[a:b] for a, b in zip([low, *end[i:j].tolist()], [*begin[i:j].tolist(), high])]
        return "".join(x for pair in zip(words, [*signs[i:j], ""]) for x in pair)


def read(html: str, sections: bool = False) -> Page:
    """A page without scripts, styles and furniture, each with all that it holds; one that is never closed takes the rest.

    With ``sections`` the parts of the page, menus and prose, stand apart. A container inside of furniture is none.
    """
    page, out, found, size, at = Page(), [], [], 0, 0
    code, nested, furniture = "", 0, 0  # the script or style that is open, how deep it and the furniture are
    stacks: dict[str, list] = {tag: [] for tag in CONTAINERS}
    for m in _MARK.finditer(html):
        closing, tag, attributes = bool(m[1]), (m[2] or "").lower(), m[3]
        if not nested and not furniture:
            piece = decode(html[at : m.start()])
            out.append(piece)
            size += len(piece)
        at = m.end()
        if nested:
            nested += (tag == code) * (-1 if closing else 1)
            continue
        if tag in ("script", "style") and not closing:
            code, nested = tag, 1
            continue
        if furniture or tag == "div" and not closing and FURNITURE.search(class_of(attributes)):
            furniture += (tag == "div") * (-1 if closing else 1)
            continue
        breaks = 2 if sections and tag in SECTIONS else 1 if tag == "br" and not closing else 0
        out.append("\n" * breaks)
        size += breaks
        if tag in stacks and not closing:
            stacks[tag].append((at, size, class_of(attributes)))
        elif tag in stacks and stacks[tag]:
            opened, begin, name = stacks[tag].pop()
            found.append((CONTAINERS.index(tag), opened, (tag, name, begin, size)))
        if closing and tag in BLOCKS:
            out.append("\n\n")
            size += 2
    if not nested and not furniture:
        out.append(decode(html[at:]))
    page.raw = "".join(out)
    page.held = [x[2] for x in sorted(found)]
    return page


def cleared(html: str) -> Page:
    return read(html)


def plain(page: Page) -> str:
    return page.text(0, len(page.raw))


def densest(html: str) -> tuple[str, str]:
    """(text, container): among the closed containers, by tag and then place, one whose text is shorter than that of the
    best so far, the whole page at first, and keeps KEEP_SHARE of it, is the best from then on."""
    page = read(html, sections=True)
    place, name = (0, len(page.raw)), "page"
    best = page.length(*place)
    for tag, classes, low, high in page.held:
        n = page.length(low, high)
        if KEEP_SHARE * best <= n < best:
            best, place, name = n, (low, high), ".".join([tag, *classes.split()[:1]])
    return page.text(*place), name


def page_text(pages: DataFrame, key: str = "page_id", html: str = "html", container: bool = False) -> DataFrame:
    """PAGES: the text of each page, or of its densest container. A null page has an empty text; rows are treated each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "html"):
            done = [densest(x or "") if container else (plain(cleared(x or "")), "page") for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([d[k] for d in done], pa.string()) for k in (0, 1))], names=[x.split()[0] for x in PAGES.split(", ")])

    return pages.select(F.col(key).cast("long").alias("key"), F.col(html).cast("string").alias("html")).mapInArrow(run, PAGES)
