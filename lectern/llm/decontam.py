"""Benchmark decontamination with spaced seeds.

Texts become lower-cased runs of letters and digits. A seed is a window of up to SPAN tokens hashed under a fixed mask that
ignores some positions, so a hit survives substitutions at those positions. Every overlap within LEAST and SHARE has a
seed under one of the three masks, wherever its substitutions are; a smaller ``share`` has no such warrant. Seeds of
texts are joined with seeds of benchmark items, and around each hit the two are compared on that diagonal: the
document is contaminated where a run of at least ``least`` tokens of the item (or the whole item, if it is shorter)
agrees in ``share`` per cent of its tokens. Items shorter than SPAN are hashed whole and must occur whole.

The benchmark's seeds reach the tasks as two bitmaps of fixed size, over different bits of the hash; they only spare the
shuffle seeds that cannot match. The match itself is a join, whatever the size of the benchmark. Texts are told apart by
their hash, so copies are compared once. Texts with a hit are read again, and of each the tokens that an item would cover
go to the comparison: an item's tokens and a text's are in one row only there, and a long item widens no other's part.

Nulls: a null text has no tokens and is clean; items with a null text or id match nothing; a document with a null doc_id
is compared and reported with null. Repeated documents are reported each once; repeated items with the same id count
once. Empty tables give no row. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .util import WordHashes, bitmap, discard, frugal, in_bitmap, pieces, stage, unused, window_sums

TOKEN = re.compile(r"[^\W_]+")
#: Positions that count. No run of 20 to 39 tokens, and no whole item of 12 to 19, with up to a fifth substituted escapes
#: all masks (the tests go through every pattern); a longer run has a half of 20 or more that agrees as well.
MASKS = ("1111011", "110010111", "11000100111")
SPAN = 12
LEAST, SHARE = 20, 80
_WORDS = WordHashes()


def masks_for(lengths: list[int]) -> list[tuple[int, str]]:
    """(salt, mask); ``lengths``: of the items that are shorter than SPAN, which are hashed whole."""
    return [*enumerate(MASKS, 1), *((100 + n, "1" * n) for n in lengths)]


def token_hashes(text: str) -> np.ndarray:
    return _WORDS.of(TOKEN.findall(text.lower()))


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_hash, n, tokens): a row for each text of an item."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            tokens = [token_hashes(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), b.column("item_hash"), pa.array([len(t) for t in tokens], pa.int32()), pa.array([t.tobytes() for t in tokens], pa.binary())], names=["item_id", "item_hash", "n", "tokens"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text").where("text is not null and item_id is not null")
    return rows.dropDuplicates(["item_id", "item_hash"]).mapInArrow(run, "item_id long, item_hash long, n int, tokens binary").where("n > 0")


def item_seeds(items: DataFrame) -> DataFrame:
    """(item_id, item_hash, n, hash, item_pos); an item shorter than SPAN has one seed."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "tokens"):
            for i, fp, n, x in zip(*(b.column(c).to_pylist() for c in ("item_id", "item_hash", "n")), b.column("tokens")):
                masks = masks_for([]) if n >= SPAN else masks_for([n])[-1:]
                sums = list(window_sums(np.frombuffer(x.as_buffer(), np.int64), masks).values())
                at = np.concatenate([np.arange(len(h)) for h in sums])
                same = [pa.array(np.full(len(at), v), t) for v, t in ((i, pa.int64()), (fp, pa.int64()), (n, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.concatenate(sums)), pa.array(at)], names=["item_id", "item_hash", "n", "hash", "item_pos"])

    return items.mapInArrow(run, "item_id long, item_hash long, n int, hash long, item_pos long")


#: Bits of a hash passed over by the second bitmap; the first takes the lowest ones.
SECOND = 24


def text_seeds(docs: DataFrame, known: tuple[np.ndarray, np.ndarray], lengths: list[int]) -> DataFrame:
    """(doc_hash, hash, pos): seeds of texts that may be in the benchmark, of copies once."""
    shared, masks = docs.sparkSession.sparkContext.broadcast(known), masks_for(lengths)
    width = {salt: len(mask) for salt, mask in masks}

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", limit=1 << 20):  # the windows of all masks take dozens of times as many bytes
            texts = [token_hashes(x) for x in b.column("text").to_pylist()]
            begins, ends, fps = np.cumsum([0, *(len(t) for t in texts)])[:-1], np.cumsum([len(t) for t in texts]), b.column("doc_hash").to_numpy()
            every, found = np.concatenate([*texts, np.empty(0, np.int64)]), []
            for salt, h in window_sums(every, masks).items():
                at = np.flatnonzero(in_bitmap(shared.value[0], h))
                at = at[in_bitmap(shared.value[1], h[at] >> SECOND)]
                doc = np.searchsorted(ends, at, side="right")
                inside = at + width[salt] <= ends[doc]  # windows over the end of a text are none of its own
                doc, at = doc[inside], at[inside]
                found.append((fps[doc], h[at], at - begins[doc]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found)], names=["doc_hash", "hash", "pos"])
        _WORDS.clear()

    return docs.select(F.xxhash64("text").alias("doc_hash"), "text").where("text is not null").mapInArrow(run, "doc_hash long, hash long, pos long").distinct()


def covered(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_hash, item_id, item_hash, shift, begin, part): of each hit the tokens of the text from ``begin`` on that the item, laid at ``shift``, covers.

    ``hits`` is (doc_hash, item_id, item_hash, n, shift). Texts without any go no further than the task that reads them.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(hits.select("doc_hash").distinct(), "doc_hash"))

    @frugal
    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(wanted.value, b.column("doc_hash").to_numpy())))

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            for fp, text, own in zip(b.column("doc_hash").to_pylist(), b.column("text").to_pylist(), b.column("hits")):
                t, own = token_hashes(text), own.values
                i, item, n, shift = (own.field(c).to_numpy() for c in ("item_id", "item_hash", "n", "shift"))
                begin, end = np.maximum(shift, 0), np.minimum(shift + n, len(t))
                for low in range(0, len(i), 1024):  # parts of few hits at a time
                    some = slice(low, low + 1024)
                    parts = pa.array([t[x:y].tobytes() for x, y in zip(begin[some].tolist(), end[some].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(parts), fp)), *(pa.array(x[some]) for x in (i, item, shift, begin)), parts], names=["doc_hash", "item_id", "item_hash", "shift", "begin", "part"])
        _WORDS.clear()

    texts = docs.select(F.xxhash64("text").alias("doc_hash"), "text").where("text is not null").mapInArrow(chosen, "doc_hash long, text string").dropDuplicates(["doc_hash"])
    per = hits.groupBy("doc_hash").agg(F.collect_list(F.struct("item_id", "item_hash", "n", "shift")).alias("hits"))
    return texts.join(per, "doc_hash").mapInArrow(cut, "doc_hash long, item_id long, item_hash long, shift long, begin long, part binary")


def best_run(equal: np.ndarray, least: int, share: int) -> tuple[int, int] | None:
    """The longest [i, j) of at least ``least`` places of which ``share`` per cent agree, both ends agreeing; None if there is none."""
    n = len(equal)
    if n < least:
        return None
    score = np.concatenate([[0], np.cumsum(np.where(equal, 100 - share, -share))])
    low = np.minimum.accumulate(score)
    best = None
    for j in range(n, least - 1, -1):  # the first prefix sum no larger than score[j] gives the longest run that ends at j
        if best and j <= best[1] - best[0]:
            break
        i = int(np.searchsorted(-low, -score[j], side="left"))
        if j - i >= least and (best is None or j - i > best[1] - best[0]):
            best = (i, j)
    if best:
        on = np.flatnonzero(equal[best[0] : best[1]])
        best = (best[0] + int(on[0]), best[0] + int(on[-1]) + 1)
    return best


OVERLAPS = "doc_hash long, item_id long, doc_begin long, item_begin long, n_tokens long, n_equal long"


def text_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """A row of OVERLAPS for each contaminated text and item, with their longest overlap, in tokens; written to the shared folder."""
    items = stage(items_of(benchmark), "items")
    seeds = stage(item_seeds(items), "item-seeds")
    lengths = sorted(r["n"] for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # fewer than SPAN numbers
    known = bitmap(seeds, "hash"), bitmap(seeds.select(F.shiftright("hash", SECOND).alias("high")), "high")
    hits = text_seeds(docs, known, lengths).join(seeds, "hash").select("doc_hash", "item_id", "item_hash", F.col("n").cast("long").alias("n"), (F.col("pos") - F.col("item_pos")).alias("shift"))
    hits = stage(hits.distinct(), "seed-hits")
    near = stage(covered(docs, hits), "covered")  # written, so that no task feeds two Python workers
    parts = near.join(items.select("item_id", "item_hash", "tokens"), ["item_id", "item_hash"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in OVERLAPS.split(", ")]
        for b in batches:
            rows = []
            for fp, i, shift, begin, x, y in zip(*(b.column(c).to_pylist() for c in ("doc_hash", "item_id", "shift", "begin")), b.column("part"), b.column("tokens")):
                d, m = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                first = begin - shift  # the item's tokens before the text begins
                equal = d == m[first : first + len(d)]
                found = best_run(equal, min(least, len(m)), share)
                if found and (len(m) >= SPAN or equal.all()):
                    rows.append((fp, i, begin + found[0], first + found[0], found[1] - found[0], int(equal[found[0] : found[1]].sum())))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=names)

    best = F.max_by(F.struct("doc_begin", "item_begin", "n_tokens", "n_equal"), F.struct("n_tokens", -F.col("doc_begin"), -F.col("item_begin"))).alias("o")
    out = stage(parts.select("doc_hash", "item_id", "shift", "begin", "part", "tokens").mapInArrow(run, OVERLAPS).groupBy("doc_hash", "item_id").agg(best).select("doc_hash", "item_id", "o.*"), "overlaps")
    discard(items, seeds, hits, near)
    return out


def find_overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(doc_id, doc_hash, item_id, doc_begin, item_begin, n_tokens, n_equal): OVERLAPS for each contaminated document."""
    found = text_overlaps(docs, benchmark, least, share)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_hash")).where("text is not null").join(found, "doc_hash").distinct().select("doc_id", *found.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """(doc_id, item_ids, n_items, n_tokens): one row for each contaminated document, none for clean ones."""
    found = find_overlaps(docs, benchmark, least, share)
    return found.groupBy("doc_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("item_id")), lambda x: x.cast("string"))).alias("item_ids"), F.countDistinct("item_id").alias("n_items"), F.max("n_tokens").alias("n_tokens"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, share: int = SHARE) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept. Rows are told apart by the hash of their text."""
    name = unused(docs, "doc_hash")
    found = text_overlaps(docs, benchmark, least, share)
    bad = stage(found.select(F.col("doc_hash").alias(name)).distinct(), "contaminated")  # written, so that its size is known to the planner
    discard(found)
    return docs.join(bad, F.xxhash64(docs["text"]) == F.col(name), "left_anti")
