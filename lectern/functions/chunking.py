"""Items into overlapping chunks with offsets: paragraphs or caption lines, filled into windows.

A unit is a paragraph (text between line ends, trimmed) or a caption line located in the text. A unit longer than ``most``
characters is cut at its last blank before the limit, or at the limit where no blank lies past ``least``. A chunk takes as
many whole units as fit into ``most`` characters; the next one begins with its last unit, and with earlier ones while the
repeated text stays within ``overlap``. Offsets count code points of the text.

All of it is done on sorted arrays of places: units are where inner characters begin and end within a line, the last unit
of a chunk and the first of the next one are found for every unit at once by bisection, and the chunks are the units that
are reached from the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import pieces

#: Characters of a chunk, of the shortest cut, of an overlap; code points that trim a unit.
MOST, LEAST, OVERLAP = 1500, 1000, 200
WHITE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
CHUNKS = "item_id long, ordinal long, char_start long, char_end long, start_ms long, end_ms long, text string"
NO_TIME = -1


class Units:
    """Places of the units of a text, in order, and when each begins and ends, NO_TIME where nothing says so."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray):
        self.codes, self.starts, self.ends, self.times = codes, starts, ends, times

    def shortened(self, most: int = MOST, least: int = LEAST) -> Units:
        """The same with every unit of more than ``most`` characters cut."""
        long = np.flatnonzero(self.ends - self.starts > most)
        if not len(long):
            return self
        blanks = np.append(np.flatnonzero(self.codes == 0x20), -1)
        parts = []
        for k in long.tolist():
            s, e = int(self.starts[k]), int(self.ends[k])
            while e - s > most:
                b = int(blanks[np.searchsorted(blanks[:-1], s + most, "right") - 1])
                stop = b if b > s + least else s + most
                parts.append((s, stop, k))
                s = stop + int(self.codes[stop] == 0x20)
            parts.append((s, e, k))
        short = np.delete(np.arange(len(self.starts)), long)
        s, e, k = (np.concatenate([x[short], new]) for x, new in zip((self.starts, self.ends, np.arange(len(self.starts))), np.array(parts, np.int64).T))
        order = np.argsort(s, kind="stable")
        return Units(self.codes, s[order], e[order], self.times[k[order]])

    def chunks(self, most: int = MOST, overlap: int = OVERLAP) -> np.ndarray:
        """(first, last) unit of each chunk."""
        own = np.arange(len(self.starts))
        last = np.maximum(np.searchsorted(self.ends, self.starts + most, "right") - 1, own)
        after = np.maximum(np.minimum(np.searchsorted(self.starts, self.ends[last] - overlap), last), own + 1)
        reached = [0] if len(own) else []
        while reached and last[reached[-1]] + 1 < len(own):
            reached.append(int(after[reached[-1]]))
        return np.stack([own[reached], last[reached]], axis=1) if reached else np.empty((0, 2), np.int64)


def _trimmed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: np.ndarray) -> Units:
    """Units without white space at their ends; those of white space alone go."""
    inner = np.flatnonzero(~np.isin(codes, WHITE))
    i, j = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
    some = np.flatnonzero(j > i)
    return Units(codes, inner[i[some]], inner[j[some] - 1] + 1, times[some])


def paragraphs(codes: np.ndarray) -> Units:
    ends = np.append(np.flatnonzero(codes == 0x0A), len(codes))
    return _trimmed(codes, np.append(0, ends[:-1] + 1), ends, np.full((len(ends), 2), NO_TIME))


def captions(codes: np.ndarray, text: str, lines: list[tuple[int, str]], duration_ms: int | None) -> Units:
    """Each line at its first place after the line before it; it ends where the next begins, the last with the recording."""
    begins = np.array([ms for ms, _ in lines], np.int64)
    until = np.append(begins[1:], begins[-1] if duration_ms is None else duration_ms)
    places, upto = np.full((len(lines), 2), -1), 0
    for k, (_, line) in enumerate(lines):
        if (at := text.find(line, upto)) >= 0:
            places[k] = at, (upto := at + len(line))
    found = np.flatnonzero(places[:, 0] >= 0)
    return _trimmed(codes, *places[found].T, np.stack([begins, until], axis=1)[found])


def units(text: str, lines: list[tuple[int, str]] | None = None, duration_ms: int | None = None) -> Units:
    """Caption units; paragraphs where there are no captions or none is found in the text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    timed = captions(codes, text, lines, duration_ms) if lines else None
    return (timed if timed is not None and len(timed.starts) else paragraphs(codes)).shortened()


def chunk_items(items: DataFrame, key: str = "item_id", body: str = "text", captions: str | None = None, duration: str | None = None) -> DataFrame:
    """A row of CHUNKS for each chunk of ``items``; each text is cut in the task that reads it, without a shuffle.

    ``captions`` names an array of structs (at in milliseconds, text), ``duration`` a number of seconds. Nulls: a null or
    blank text has no chunk; a null key stays null; caption lines without a time or text are passed over. Repeated rows
    are cut each. Texts of any length are taken, a few megabytes at a time. An empty table gives no row.
    """
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "body"):
            out = [[] for _ in names]
            for k, text, lines, seconds in zip(*(b.column(c).to_pylist() for c in ("key", "body", "lines", "seconds"))):
                if not text:
                    continue
                said = [(x["at"], x["text"]) for x in lines or [] if x and x["at"] is not None and x["text"] is not None]
                own = units(text, said, None if seconds is None else int(seconds * 1000))
                first, last = own.chunks().T
                starts, ends = own.starts[first].tolist(), own.ends[last].tolist()
                times = [[None if t == NO_TIME else t for t in x.tolist()] for x in (own.times[first, 0], own.times[last, 1])]
                for c, values in zip(out, ([k] * len(starts), range(len(starts)), starts, ends, *times, [text[i:j] for i, j in zip(starts, ends)])):
                    c.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "text" else pa.int64()) for n, c in zip(names, out)], names=names)

    lines = F.col(captions) if captions else F.lit(None)
    given = [F.col(key).cast("long").alias("key"), F.col(body).cast("string").alias("body"), lines.cast("array<struct<at:bigint,text:string>>").alias("lines"), (F.col(duration) if duration else F.lit(None)).cast("double").alias("seconds")]
    return items.select(*given).mapInArrow(run, CHUNKS)


def chunk_of(places: DataFrame, chunks: DataFrame) -> DataFrame:
    """``places(item_id, at)`` with the ordinal of the first chunk of the item that holds the character ``at``; null if none does.

    Chunks begin at most ``MOST`` characters before a place they hold, so both sides meet in blocks of that many characters
    of an item: a long item is spread, and a place meets the few chunks of its block alone.
    """
    spread = chunks.select("item_id", "ordinal", "char_start", "char_end", F.explode(F.expr(f"sequence(char_start div {MOST}, (char_end - 1) div {MOST})")).alias("block"))
    asked = places.withColumn("block", F.expr(f"at div {MOST}"))
    near = asked.alias("p").join(spread.alias("c"), (F.col("p.item_id") == F.col("c.item_id")) & (F.col("p.block") == F.col("c.block")) & (F.col("at") >= F.col("char_start")) & (F.col("at") < F.col("char_end")), "left")
    return near.groupBy(*[F.col(f"p.{c}").alias(c) for c in places.columns]).agg(F.min("c.ordinal").alias("ordinal"))
