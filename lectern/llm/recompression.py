"""Repeated passages by recompression: windows of words that also start in a document with a smaller doc_id go.

* A text is a string of word symbols. A round first names the inside of each run of equal symbols, then joins each symbol
  of the left kind with one of the right kind that follows it. Kind and name are hashes of the symbols and the round, so
  every task gives equal strings the same names: a round needs no dictionary and no shuffle, and the rounds of a text
  are done at once.
* What may merge with symbols outside of a window is left out of the window at each round. What remains, its inside, is
  named alike wherever the window stands. The ends of a run stay symbols of their own, so that a run which goes on
  outside costs a window no more than the part of it that it shows.
* A window's high-level symbol is, of the neighbouring triples of symbols in its inside after ROUNDS rounds (of the last
  round before which fewer than three would remain, else its first symbol), the one with the smallest name. Neighbouring
  windows share theirs, so a text has about two for nine words. Windows with equal words have the same one, hence only
  windows whose high-level symbol is found in several documents can repeat: these are revealed.
* Revealed windows are verified by 96 bits of two hashes over their words, the smallest doc_id of each is found, and the
  places of those that stand in a document with a larger one are gathered by document.

Equal texts are taken once, under their smallest doc_id; the others repeat it as a whole. Hot passages are summed up before
they are shuffled (a smallest and a largest doc_id for each), their places joined by Spark, which splits skewed keys.
Up to a counted bound, shared names travel as a bitmap of fixed size; beyond it the places of windows are joined with them.
Copies, verified windows and texts without repeats are passed over by such bitmaps too, which only save work: where they
are full more rows are joined, and the result is the same. Up to the bound, texts are shuffled only where they hold repeats.

Nulls: a null text has no words; a row with a null doc_id is kept whole and repeats for nobody, as no id is smaller. Rows
that share a doc_id do not repeat each other. Texts of fewer words than a window stay as they are. Long texts are taken in
blocks of BLOCK words, which overlap by a window. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import BLANKS, bitmap, byte_codes, discard, hashed_words, in_bitmap, pieces, small_batches, stage, window_sums

WINDOW, ROUNDS, TRIPLE = 13, 2, 3
BLOCK = 1 << 20
CODES = byte_codes(BLANKS, lower=False)
#: Bits of the bitmaps: 2 MB each. Up to FULL shared names are told by a bitmap, more by a join.
BITS = 1 << 24
FULL = BITS >> 3
#: Odd multipliers of the names.
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xE7037ED1A0B428DB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """The windows of a string of symbols and, round after round, the inside [low, high) of each that is still open."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, at: np.ndarray, width: int):
        self.symbols, self.first = symbols, first
        self.open, self.low, self.high = np.arange(len(at)), at, at + width
        self.names = np.zeros(len(at), np.uint64)
        self.round = 0

    def close(self, which: np.ndarray, triple: bool = True) -> None:
        """Names the windows at the places ``which`` of the open ones from their inside, and takes them off."""
        low, count = self.low[which], np.maximum(self.high[which] - self.low[which] - (TRIPLE - 1), 1)
        if not triple:
            self.names[self.open[which]] = _mixed(self.symbols[low] * _C + np.uint64(self.round))
        else:
            every = self.symbols * _C + np.uint64(self.round)
            for k in range(1, TRIPLE):
                every = every[:-1] * _A + self.symbols[k:]
            least = [_mixed(every)]  # of 1, 2, 4 and 8 neighbours
            while 2 << (len(least) - 1) <= WINDOW:
                k = 1 << (len(least) - 1)
                least.append(np.minimum(least[-1][:-k], least[-1][k:]) if len(least[-1]) > k else least[-1][:0])
            power = np.frexp(count.astype(float))[1] - 1
            for p in np.unique(power).tolist():
                own = np.flatnonzero(power == p)
                self.names[self.open[which[own]]] = np.minimum(least[p][low[own]], least[p][low[own] + count[own] - (1 << p)])
        rest = np.ones(len(self.open), bool)
        rest[which] = False
        self.open, self.low, self.high = self.open[rest], self.low[rest], self.high[rest]

    def keep(self, kept: np.ndarray) -> None:
        """Leaves out the symbols that became part of one before them."""
        place = np.cumsum(kept) - 1
        self.symbols, self.first = self.symbols[kept], self.first[kept]
        self.low, self.high = place[self.low], place[self.high - 1] + 1

    def runs(self) -> None:
        same = np.zeros(len(self.symbols) + 1, bool)  # as the symbol before it
        same[1:-1] = (self.symbols[1:] == self.symbols[:-1]) & ~self.first[1:]
        if not same.any():
            return
        begin, end = np.flatnonzero(same[1:] & ~same[:-1]), np.flatnonzero(same[:-1] & ~same[1:]) + 1
        lead = np.flatnonzero(same[self.low + 1])
        stop = end[np.searchsorted(begin, self.low[lead], "right") - 1]
        whole = stop >= self.high[lead]
        self.low[lead[~whole]] = stop[~whole] - 1  # the last symbol of a run stays as it is, wherever the run began
        self.close(lead[whole], triple=False)
        tail = np.flatnonzero(same[self.high - 1])
        self.high[tail] = np.maximum(begin[np.searchsorted(begin, self.high[tail] - 1, "right") - 1], self.low[tail]) + 1
        size = end - begin
        begin, size = begin[size > 2], size[size > 2]
        if len(begin):
            self.symbols = self.symbols.copy()
            self.symbols[begin + 1] = _mixed(self.symbols[begin] * _A + size.astype(np.uint64) * _B + np.uint64(2 * self.round + 1))
            kept = np.ones(len(self.symbols), bool)
            gone = size - 3
            kept[np.repeat(begin + 2 - np.cumsum(gone) + gone, gone) + np.arange(gone.sum())] = False
            self.keep(kept)

    def pairs(self) -> None:
        right = (_mixed(self.symbols * _B + np.uint64(self.round)) & np.uint64(1)).astype(bool)
        self.close(np.flatnonzero(self.high - self.low < TRIPLE), triple=False)  # runs left few symbols
        self.close(np.flatnonzero(self.high - ~right[self.high - 1] - self.low - right[self.low] < TRIPLE))
        self.low, self.high = self.low + right[self.low], self.high - ~right[self.high - 1]
        joined = np.zeros(len(self.symbols), bool)
        joined[1:] = right[1:] & ~right[:-1] & ~self.first[1:]
        at = np.flatnonzero(joined)
        self.symbols = self.symbols.copy()
        self.symbols[at - 1] = _mixed(self.symbols[at - 1] * _A + self.symbols[at] * _B + np.uint64(2 * self.round))
        self.keep(~joined)


def high_symbols(words: np.ndarray, counts: np.ndarray, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(place, name) of each window of ``width`` words that lies in one text, over the word hashes of texts in a row."""
    first = np.zeros(len(words), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    at = np.flatnonzero(np.arange(len(words)) + width <= np.repeat(np.cumsum(counts), counts))
    with np.errstate(over="ignore"):
        w = Windows(words.view(np.uint64), first, at.copy(), width)
        for _ in range(rounds):
            w.runs()
            w.pairs()
            w.round += 1
        w.close(np.flatnonzero(w.high - w.low < TRIPLE), triple=False)
        w.close(np.arange(len(w.open)))
    return at, w.names.view(np.int64)


def _blocks(texts: pa.Array, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, words of each text, row of each text, its first place) of at most about ``most`` words: whole texts, or a part of one."""
    words, counts = hashed_words(texts, codes=CODES)
    ends = np.cumsum(counts)
    i = 0
    while i < len(counts):
        start = ends[i] - counts[i]
        j = max(int(np.searchsorted(ends, start + most, "right")), i + 1)
        for at in range(0, max(int(counts[i]) - width + 1, 1) if j == i + 1 else 1, most):
            stop = min(ends[j - 1], start + at + most + width - 1)
            own = counts[i:j] if j > i + 1 else np.array([stop - start - at])
            yield words[start + at : stop], own, np.arange(i, j), np.full(j - i, at)
        i = j


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rep): ``rep`` stands for the text of a row among those of its doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rep", F.xxhash64("doc_id", "text"))


def repeats(docs: DataFrame, width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, rep, whole, places) of the rows that hold repeats: ``places`` are the words at which repeated windows start,
    ``whole`` says that the text as a whole repeats another."""
    rows = _rows(docs).where("doc_id is not null")
    texts = stage(rows.select("doc_id", "rep", F.md5("text").alias("key"), F.octet_length("text").alias("size")).where(f"size >= {2 * width - 1}"), "texts")
    firsts = texts.groupBy("key", "size").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    copies = texts.join(firsts.where("first < last"), ["key", "size"]).where("doc_id > first").select("doc_id", "rep").distinct()
    copies = stage(copies, "copies")
    kept = texts.join(copies, ["doc_id", "rep"], "left_anti")
    spark = docs.sparkSession
    alone = spark.sparkContext.broadcast(bitmap(kept, "rep", BITS))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each block of texts that aren't copies: the batch, and of each window its row, place, name and place among the words."""
        for b in pieces(batches, "text"):
            b = b.filter(pa.array(in_bitmap(alone.value, b.column("rep").to_numpy(), BITS)))
            for words, counts, row, start in _blocks(b.column("text"), width, block):
                at, names = high_symbols(words, counts, width)
                text = np.repeat(np.arange(len(counts)), counts)[at]
                yield b, row[text], at - (np.cumsum(counts) - counts)[text] + start[text], names, words, at

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, _, names, _, _ in windows(batches):
            if not len(row):
                continue
            ids = b.column("doc_id").to_numpy()[row]
            order = np.lexsort((ids, names))
            names, ids = names[order], ids[order]
            cut = np.append(0, np.flatnonzero(names[1:] != names[:-1]) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(names[cut]), pa.array(ids[cut]), pa.array(ids[np.append(cut[1:], len(ids)) - 1])], names=["name", "low", "high"])

    seen = rows.mapInArrow(named, "name long, low long, high long").groupBy("name").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    seen = stage(seen.select("name"), "names")
    few = seen.count() <= FULL
    shared = spark.sparkContext.broadcast(bitmap(seen, "name", BITS)) if few else None

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, doc_id, rep, place, n): the n windows from a place on that share a name."""
        for b, row, place, names, _, _ in windows(batches):
            if not len(row):
                continue
            cut = np.append(0, np.flatnonzero((names[1:] != names[:-1]) | (row[1:] != row[:-1])) + 1)
            ids, reps = (b.column(c).to_numpy()[row[cut]] for c in ("doc_id", "rep"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names[cut], ids, reps, place[cut], np.diff(cut, append=len(row)))], names=["name", "doc_id", "rep", "place", "n"])

    source = rows
    if not few:
        of = rows.mapInArrow(stretches, "name long, doc_id long, rep long, place long, n long").join(seen, "name", "left_semi")
        of = of.groupBy("doc_id", "rep").agg(F.collect_list("place").alias("open"), F.collect_list("n").alias("many"))
        source = stage(rows.join(of, ["doc_id", "rep"]).select(*rows.columns, "open", "many"), "revealed")

    def revealed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b, row, place, names, words, at in windows(batches):
            if few:
                own = np.flatnonzero(in_bitmap(shared.value, names, BITS))
            else:
                starts, many = b.column("open"), b.column("many").flatten().to_numpy()
                first = np.repeat(np.arange(b.num_rows), starts.value_lengths().to_numpy()) << 40 | starts.flatten().to_numpy()
                known = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                own = np.flatnonzero(np.isin(row.astype(np.int64) << 40 | place, known))
            sums = [np.zeros(len(own), np.uint64) for _ in range(2)]
            with np.errstate(over="ignore"):
                for k in range(width):
                    symbol = words[at[own] + k].view(np.uint64)
                    for s, factor in zip(sums, (_A, _B)):
                        s *= factor
                        s += _mixed(symbol + factor)
                one, two = (_mixed(s).view(np.int64) for s in sums)
            ids, reps = (b.column(c).to_numpy()[row[own]] for c in ("doc_id", "rep"))
            yield ids, reps, place[own], one, (two >> 32).astype(np.int32)

    def seen_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, one, two in revealed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(ids)], names=["one", "two", "doc_id"])

    least = source.mapInArrow(seen_windows, "one long, two int, doc_id long").groupBy("one", "two").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    least = stage(least.where("first < last").select("one", "two", "first"), "windows")
    found = spark.sparkContext.broadcast(bitmap(least, "one", BITS))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, reps, place, one, two in revealed(batches):
            own = pa.array(in_bitmap(found.value, one, BITS))
            yield pa.RecordBatch.from_arrays([pa.array(x).filter(own) for x in (one, two, ids, reps, place)], names=["one", "two", "doc_id", "rep", "place"])

    places = source.mapInArrow(placed, "one long, two int, doc_id long, rep long, place long").join(least, ["one", "two"]).where("doc_id > first")
    parts = places.groupBy("doc_id", "rep").agg(F.lit(False).alias("whole"), F.collect_list(F.col("place").cast("int")).alias("places"))
    parts = parts.join(copies, ["doc_id", "rep"], "left_anti")  # of copies that a full bitmap did not pass over
    out = stage(parts.union(copies.select("doc_id", "rep", F.lit(True), F.array().cast("array<int>"))), "repeats")
    discard(texts, copies, seen, least, *([] if few else [source]))
    return out


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): ``kept`` are the words of a text that no repeated window covers, joined by blanks."""
    rows = _rows(docs)
    held = repeats(docs, width, block)
    touched = docs.sparkSession.sparkContext.broadcast(bitmap(held, "rep", BITS))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        whole, places = (b.column(c).to_pylist() if c in b.schema.names else [None] * b.num_rows for c in ("whole", "places"))
        for text, every, starts in zip(b.column("text"), whole, places):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n.append(len(words))
            if every and len(words) >= width:
                kept.append(b"")
            elif starts:
                mark = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.array(starts))
                mark[starts] += 1
                mark[starts + width] -= 1
                words = [words[k] for k in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()]
                kept.append(b" ".join(words))
            else:
                kept.append(b" ".join(words))
            gone.append(n[-1] - (0 if every and n[-1] >= width else len(words)))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=[x.split()[0] for x in KEPT.split(", ")])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield cut(b.filter(pa.array(~in_bitmap(touched.value, b.column("rep").to_numpy(), BITS))))

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield b.filter(pa.array(in_bitmap(touched.value, b.column("rep").to_numpy(), BITS)))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield cut(b)

    with small_batches(docs.sparkSession):
        plain = rows.mapInArrow(untouched, KEPT)
        some = rows.mapInArrow(maybe, "doc_id long, text string, rep long").alias("d").join(held.alias("h"), F.expr("d.doc_id = h.doc_id and d.rep = h.rep"), "left")
        return plain.union(some.select("d.doc_id", "d.text", "h.whole", "h.places").mapInArrow(joined, KEPT))
