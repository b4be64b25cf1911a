"""Longest spans that a reply shares with a record, each pair in time that grows with its length alone.

The reply becomes a suffix automaton: states for its substrings, with a link from each to its longest shorter relative.
The record is then read once, character by character, with the longest of its endings that the reply holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.batches import pieces

#: Fixed value: characters of the shortest span that counts.
LEAST = 6


class Substrings:
    """The suffix automaton of a text: ``steps`` by state, the length of a state's longest substring, its link, and where
    its substrings first end."""

    def __init__(self, text: str):
        self.steps: list[dict[str, int]] = [{}]
        self.length, self.link, self.first = [0], [-1], [0]
        last = 0
        for at, c in enumerate(text, 1):
            last = self._add(last, c, at)

    def _state(self, steps: dict[str, int], length: int, link: int, first: int) -> int:
        self.steps.append(steps)
        self.length.append(length)
        self.link.append(link)
        self.first.append(first)
        return len(self.steps) - 1

    def _add(self, last: int, c: str, at: int) -> int:
        new, p = self._state({}, at, 0, at), last
        while p >= 0 and c not in self.steps[p]:
            self.steps[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.steps[p][c]
            if self.length[q] != self.length[p] + 1:
                split = self._state(dict(self.steps[q]), self.length[p] + 1, self.link[q], self.first[q])
                while p >= 0 and self.steps[p].get(c) == q:
                    self.steps[p][c] = split
                    p = self.link[p]
                self.link[q] = q = split
            self.link[new] = q
        return new

    def longest_in(self, record: str) -> tuple[int, int]:
        """(begin, length) in the text of the longest span that the record holds too; of several the first in the text."""
        state, n, best = 0, 0, (0, 0)
        for c in record:
            while state and c not in self.steps[state]:
                state = self.link[state]
                n = self.length[state]
            state = self.steps[state].get(c, 0)
            n = n + 1 if state else 0
            if n > best[1] or n == best[1] and self.first[state] - n < best[0]:
                best = (self.first[state] - n, n)
        return best


def flattened(text: Column) -> Column:
    """Lower-cased, with white space as single blanks: what a transcript's lines differ by."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def longest_shared(pairs: DataFrame, keys: list[str], reply: Column, record: Column) -> DataFrame:
    """(*keys, span, length) of rows of ``pairs``: the longest span of at least LEAST characters that a reply, without its
    urls, shares with a record, both flattened; an empty one where there is none, or either is null.

    Pairs are independent: no shuffle, no table of positions, and memory in proportion to one reply. Of longest spans the
    first in the reply counts.
    """
    said = F.coalesce(flattened(F.regexp_replace(reply, r"(?i)https?://\S+", "")), F.lit("")).alias("reply")
    given = pairs.select(F.struct(*[F.col(k) for k in keys]).alias("own"), said, F.coalesce(flattened(record), F.lit("")).alias("record"))
    out = StructType([given.schema["own"], StructField("span", StringType()), StructField("length", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, automaton = None, None
        for b in pieces(batches, "record"):
            spans = []
            for text, body in zip(b.column("reply").to_pylist(), b.column("record").to_pylist()):
                if min(len(text), len(body)) < LEAST:
                    spans.append("")
                    continue
                if text != known:  # pairs of one reply often come together
                    known, automaton = text, Substrings(text)
                begin, n = automaton.longest_in(body)
                spans.append(text[begin : begin + n] if n >= LEAST else "")
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(spans, pa.string()), pa.array([len(x) for x in spans], pa.int64())], names=["own", "span", "length"])

    return given.mapInArrow(run, out).select("own.*", "span", "length")


#: Characters of texts that meet at a time; places looked at, of all lengths, before long spans are followed by an automaton.
PART, PLACES = 1 << 18, 1 << 25
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _among(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    every = np.unique(others)
    return every[np.minimum(np.searchsorted(every, values), len(every) - 1)] == values


def longest_each(replies: list[str], text: str) -> list[int]:
    """The length of the longest span of LEAST characters or more that each reply shares with ``text``; 0 where there is none.

    Spans of all places are hashed, character by character longer; places whose span the other side hasn't fall out, so
    that few are left after the first. What is found last is looked up in the text itself.
    """
    best, last = np.zeros(len(replies), np.int64), np.zeros(len(replies), np.int64)
    sizes = np.array([len(r) for r in replies], np.int64)
    x, t, n = _codes("".join(replies)), _codes(text), LEAST
    begins = np.cumsum(sizes) - sizes
    who, until = np.repeat(np.arange(len(replies)), sizes), np.repeat(begins + sizes, sizes)
    at, there = np.flatnonzero(np.arange(len(x)) + n <= until), np.arange(max(len(t) - n + 1, 0))
    hx, ht = np.zeros(len(at), np.uint64), np.zeros(len(there), np.uint64)
    for k in range(n):
        hx, ht = hx * _BASE + x[at + k], ht * _BASE + t[there + k]
    followed, looked = np.empty(0, np.int64), 0
    while len(at) and len(there):
        keep = _among(hx, ht)
        at, hx = at[keep], hx[keep]
        if not len(at):
            break
        best[who[at]], last[who[at]] = n, at
        keep = _among(ht, hx)
        there, ht = there[keep], ht[keep]
        looked += len(at) + len(there)
        if looked > PLACES:
            followed = np.unique(who[at])
            break
        on, far = at + n < until[at], there + n < len(t)
        at, there = at[on], there[far]
        hx, ht = hx[on] * _BASE + x[at + n], ht[far] * _BASE + t[there + n]
        n += 1
    out = best.tolist()
    for i in np.flatnonzero(best).tolist():
        begin = int(last[i] - begins[i])
        if i in followed or replies[i][begin : begin + out[i]] not in text:  # or two spans have one hash
            length = Substrings(replies[i]).longest_in(text)[1]
            out[i] = length if length >= LEAST else 0
    return out


def _parts(texts: list[str], overlap: int, part: int) -> Iterator[list[str]]:
    """The texts in lists of about ``part`` characters; a longer one is cut into pieces that overlap."""
    own, n = [], 0
    for t in texts:
        for at in range(0, max(len(t) - overlap, 1), part):
            piece = t[at : at + part + overlap]
            if n and n + len(piece) > part:
                yield own
                own, n = [], 0
            own.append(piece)
            n += len(piece)
    if own:
        yield own


def _across(records: list[str], body: str, replies: dict[str, int]) -> None:
    """Raises each reply's longest span to those that begin in a record and end in the body behind it, a blank between."""
    trie: dict = {}
    for r in records:
        node = trie
        for c in reversed(r):
            node = node.setdefault(c, {})
    for reply in replies:
        at = reply.find(f" {body[0]}")
        while at >= 0:
            node, back = trie, at - 1
            while back >= 0 and reply[back] in node:
                node = node[reply[back]]
                back -= 1
            n, most = at + 1, min(len(reply), at + 1 + len(body))
            while n < most and reply[n] == body[n - at - 1]:
                n += 1
            replies[reply] = max(replies[reply], n - 1 - back)
            at = reply.find(f" {body[0]}", at + 1)


def longest_of(replies: list[str], records: list[str], bodies: list[str], part: int = PART) -> dict[str, int]:
    """Each reply with the length of the longest span that it shares with a record and a body behind it, a blank between;
    all are flattened. Records and bodies are gone through once for many replies, and memory is in proportion to ``part``
    and the texts. Shorter ones than LEAST may come out as 0."""
    best = dict.fromkeys(replies, 0)
    overlap = max(map(len, best), default=0)
    before = [f"{r} " if r and any(bodies) else r for r in records]  # the blank may end a span
    for own in _parts([t for t in dict.fromkeys([*before, *bodies]) if len(t) >= LEAST], overlap, part):
        text = "\n".join(own)  # a flattened text has no line end
        for some in _parts(list(best), len(max(best, key=len)), part):
            for r, n in zip(some, longest_each(some, text)):
                best[r] = max(best[r], n)
    ends = [r for r in dict.fromkeys(r[-overlap:] for r in records) if r and overlap]
    for body in filter(None, dict.fromkeys(bodies)):
        for own in _parts(ends, overlap, part):
            _across(own, body, best)
    return best


def longest_by_record(replies: DataFrame, records: DataFrame, bodies: DataFrame) -> DataFrame:
    """(*columns of ``replies`` but its text, other, longest, n): over the records of each ``other``, with a body behind each,
    the longest span as ``longest_shared`` finds it, 0 where there is none, and how many different pairs of texts there are.

    ``replies`` is (..., other, said), ``records`` (other, record) and ``bodies`` (other, body), all texts as they come;
    an ``other`` without a body has an empty one, one without a record gives no row. Repeated rows count once. What is
    said of one ``other``, and its texts, are held by one task, hashes of a part of them at a time.
    """
    keys = [c for c in replies.columns if c not in ("other", "said")]
    replies, records = replies.distinct(), records.where("other is not null and record is not null").distinct()
    bodies = bodies.join(records.select("other").distinct(), "other", "left_semi").select("other", F.coalesce("body", F.lit("")).alias("body")).distinct()
    several = bodies.groupBy("other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("other")
    one = records.join(several, "other", "left_anti").groupBy("other").agg(F.count(F.lit(1)).alias("texts"))
    more = records.join(several, "other").join(bodies, "other").groupBy("other").agg(F.countDistinct(F.concat("record", F.lit(" "), "body")).alias("texts"))

    said = F.coalesce(flattened(F.regexp_replace("said", r"(?i)https?://\S+", "")), F.lit(""))
    kind = StructType([replies.schema[k] for k in keys])
    none = F.lit(None).cast(kind)
    rows = replies.where("other is not null").select("other", F.lit(2).alias("kind"), F.struct(*keys).alias("own"), said.alias("text"))
    rows = rows.unionByName(records.select("other", F.lit(0).alias("kind"), none.alias("own"), F.coalesce(flattened(F.col("record")), F.lit("")).alias("text")))
    rows = rows.unionByName(bodies.select("other", F.lit(1).alias("kind"), none.alias("own"), flattened(F.col("body")).alias("text")))
    out = StructType([rows.schema["other"], StructField("own", kind), StructField("length", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, texts, own = None, ([], [], []), []

        def given() -> Iterator[pa.RecordBatch]:
            if texts[0] and texts[2]:
                best = longest_of(texts[2], texts[0], texts[1] or [""])
                lengths = [best[t] if best[t] >= LEAST else 0 for t in texts[2]]
                yield pa.RecordBatch.from_arrays([pa.array([last] * len(lengths), others), pa.concat_arrays(own), pa.array(lengths, pa.int64())], names=["other", "own", "length"])

        for b in pieces(batches, "text"):
            others = b.column("other").type
            for i, (other, k, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("other", "kind", "text")))):
                if other != last:
                    yield from given()
                    last, texts, own = other, ([], [], []), []
                texts[k].append(text)
                if k == 2:
                    own.append(b.column("own").slice(i, 1))
        yield from given()

    lengths = rows.repartition("other").sortWithinPartitions("other", "kind").mapInArrow(run, out)
    per = lengths.select("own.*", "other", "length").groupBy(*keys, "other").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("replies"))
    return per.join(one.unionByName(more), "other").select(*keys, "other", "longest", (F.col("replies") * F.col("texts")).alias("n"))
