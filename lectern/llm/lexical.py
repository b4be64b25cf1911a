"""Ranked lexical search over an index in strata of equal length normaliser.

Scores are whole numbers. A document of n terms has the normaliser ``m = 25 + (75 * n * N) div L``; an occurrence count tf
gives the impact ``(10**9 * tf) div (1000 * tf + 8 * m)``, which depends on tf and m alone. So documents of equal m are
kept together, their postings by falling tf under each term, and the impact of a tf is computed once for a stratum.

* ``build`` counts the terms of each text, deals documents by their normaliser (hot ones over parts, by exact counts), and
  writes segments: at most DOCS documents of one stratum with a dictionary of term hashes, postings and their tf.
* ``search`` takes a table of items in blocks. A first pass over the dictionaries counts the documents of the items' terms,
  a second one ranks: the largest tf of each term in a segment bounds every item's score there, segments are visited in
  the order of their bounds, and an item passes a segment by whose bound cannot reach its k-th score so far. Items that
  stay are scored over a segment's documents at once, as a product of weights and impacts. A task keeps k documents an
  item; those of all tasks are ranked in two steps.

All documents are scored or proven out of reach; nothing is sampled. Terms are told apart by 64-bit hashes. Items are the
small side: they pass through the driver in blocks of ITEMS bytes, each of which is a pass over the index.

Nulls: a null or empty text has no terms, counts for nothing and is never found; a document without a doc_id counts in all
statistics, but is not ranked, as nothing names it. A null item text finds nothing. Repeated documents are ranked each,
equal scores by doc_id; repeated items have a ranking each. Long texts are counted whole. An empty table gives no row, nor
do items without terms. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .util import byte_codes, discard, hashed_words, pieces, stage, word_starts

#: Terms are runs of digits, ASCII letters and anything beyond ASCII; only A-Z are lower-cased.
CODES = byte_codes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Documents and postings of a segment; strata that hold more than one of FEW documents are counted one by one.
DOCS, POSTINGS, FEW = 1024, 1 << 18, 4096
#: Bytes of item texts in a block; parts in which the tasks' best are ranked first.
ITEMS, PARTS = 16 << 20, 64
#: Whole numbers below it are exact as doubles.
EXACT = 1 << 53


@dataclass
class Index:
    """Segments, the number of documents with a term, and that of all terms."""

    segments: DataFrame
    n_docs: int
    n_terms: int


SEGMENT = "m long, docs array<long>, terms array<long>, ends array<int>, tfs array<int>, places array<int>"


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text"):
        _, at, starts = word_starts(b.column("text"), CODES)
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(np.searchsorted(starts, at)))], names=["n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, terms, tfs): the distinct term hashes of a text in order, and how often each occurs."""
    for b in pieces(batches, "text"):
        words, counts = hashed_words(b.column("text"), codes=CODES)
        terms, tfs, at = [], [], 0
        for n in counts.tolist():
            t, c = np.unique(words[at : at + n], return_counts=True)
            terms.append(t.tobytes())
            tfs.append(c.astype(np.int32).tobytes())
            at += n
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tfs"])


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), kind))


def _segment(m: int, ids: list, terms: list[bytes], tfs: list[bytes]) -> tuple:
    """A row of SEGMENT; documents without an id are counted, and left out of ``docs``."""
    t, tf = np.frombuffer(b"".join(terms), np.int64), np.frombuffer(b"".join(tfs), np.int32)
    place = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 8 for x in terms])
    order = np.lexsort((-tf, t))
    t = t[order]
    ends = np.append(np.flatnonzero(t[1:] != t[:-1]) + 1, len(t))
    return m, np.array([] if ids[0] is None else ids, np.int64), t[ends - 1], ends.astype(np.int32), tf[order], place[order]


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[_lists([r[k + 1] for r in rows], kind) for k, kind in enumerate(kinds)]], names=[x.split()[0] for x in SEGMENT.split(", ")])

    key, ids, terms, tfs, size, out, held = None, [], [], [], 0, [], 0
    for b in batches:
        for m, part, i, t, f in zip(*(b.column(c).to_pylist() for c in ("m", "part", "doc_id", "terms", "tfs"))):
            own = (m, part, i is None)
            if ids and (own != key or len(ids) == most or size + len(t) // 8 > POSTINGS):
                out.append(_segment(key[0], ids, terms, tfs))
                held += size
                ids, terms, tfs, size = [], [], [], 0
                if held > POSTINGS:
                    yield batch(out)
                    out, held = [], 0
            key = own
            ids.append(i)
            terms.append(t)
            tfs.append(f)
            size += len(t) // 8
    if ids:
        out.append(_segment(key[0], ids, terms, tfs))
    if out:
        yield batch(out)


def build(docs: DataFrame, most: int = DOCS, few: int = FEW) -> Index:
    """The index of ``docs(doc_id, text)``, written to the shared folder; ``most`` documents a segment."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lengths = stage(rows.select("text").mapInArrow(_lengths, "n long").where("n > 0").groupBy("n").agg(F.count(F.lit(1)).alias("c")), "lengths")
    n_docs, n_terms = lengths.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("c")), F.lit(0))).first()
    m = F.expr(f"25L + (75L * n * {n_docs}L) div {max(n_terms, 1)}L").alias("m")
    # fewer than ``few`` strata hold more than one of ``few`` documents; each other one is dealt over as many parts as the largest of them needs
    hot = F.broadcast(stage(lengths.groupBy(m).agg(F.sum("c").alias("c")).where(F.col("c") * few > n_docs), "hot-strata"))
    counted = rows.mapInArrow(_counted, "doc_id long, n long, terms binary, tfs binary").where("n > 0").withColumn("m", m).join(hot, "m", "left")
    parts = F.ceil(F.coalesce("c", F.lit(-(-n_docs // few))) / most)
    dealt = counted.select("m", F.pmod(F.xxhash64("doc_id", "terms"), parts).alias("part"), "doc_id", "terms", "tfs").repartition("m", "part").sortWithinPartitions("m", "part", "doc_id")
    segments = stage(dealt.mapInArrow(lambda batches: _segments(batches, most), SEGMENT), "segments")
    discard(lengths)
    return Index(segments, n_docs, n_terms)


@dataclass
class Items:
    """A block of items: their ids, the distinct terms of all of them in order, and each item's weights in rows."""

    ids: list
    terms: np.ndarray
    ptr: np.ndarray
    cols: np.ndarray
    weights: np.ndarray


def _blocks(items: DataFrame) -> Iterator[Items]:
    """Items with at least one term; ``weights`` are the occurrences of the terms until they are weighed."""

    def block(rows: list) -> Items:
        words, counts = hashed_words(pa.array([r.text for r in rows], pa.string()), codes=CODES)
        terms = np.unique(words)
        ids, cols, weights, at = [], [], [], 0
        for r, n in zip(rows, counts.tolist()):
            if n:
                t, c = np.unique(words[at : at + n], return_counts=True)
                ids.append(r.item_id)
                cols.append(np.searchsorted(terms, t))
                weights.append(c.astype(np.int64))
            at += n
        return Items(ids, terms, np.concatenate([[0], np.cumsum([len(c) for c in cols])]).astype(np.int64), np.concatenate([*cols, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*weights, np.empty(0, np.int64)]).astype(np.int64))

    rows, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        if rows and size + 4 * len(r.text or "") > ITEMS:
            yield block(rows)
            rows, size = [], 0
        rows.append(r)
        size += 4 * len(r.text or "")
    if rows:
        yield block(rows)


def _columns(b: pa.RecordBatch, *names: str) -> list[list[np.ndarray]]:
    """List columns as arrays, row by row."""
    out = []
    for name in names:
        c = b.column(name)
        at, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
        out.append([flat[i:j] for i, j in zip(at, at[1:])])
    return out


def _present(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``wanted``, places in ``terms``) of the values that both sorted arrays hold."""
    small, large = (terms, wanted) if len(terms) < len(wanted) else (wanted, terms)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    own = np.flatnonzero(large[at] == small) if len(large) else np.empty(0, np.int64)
    return (at[own], own) if small is terms else (own, at[own])


def document_frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """In how many documents each of the sorted ``terms`` occurs, from the dictionaries alone."""
    wanted = index.segments.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(wanted.value), np.int64)
        for b in batches:
            for own, ends in zip(*_columns(b, "terms", "ends")):
                q, t = _present(own, wanted.value)
                df[q] += np.diff(ends, prepend=0)[t]
        q = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(df[q])], names=["q", "df"])

    out = np.zeros(len(terms), np.int64)
    for q, df in index.segments.select("terms", "ends").mapInArrow(run, "q long, df long").groupBy("q").agg(F.sum("df")).collect():  # a row a term at most
        out[q] = df
    return out


class Best:
    """The k best documents of each item so far: scores fall, equal ones are in order of doc_id."""

    def __init__(self, n: int, k: int):
        self.k, self.docs, self.scores = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.least = np.ones(n, np.int64)  # what a document needs at least

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        docs, scores = np.concatenate([self.docs[item], docs]), np.concatenate([self.scores[item], scores])
        if len(scores) > self.k:
            own = np.flatnonzero(scores >= np.partition(scores, -self.k)[-self.k])
            docs, scores = docs[own], scores[own]
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs[item], self.scores[item] = docs[order], scores[order]
        if len(order) == self.k:
            self.least[item] = max(int(scores[order[-1]]), 1)


def _visit(items: Items, exact: bool, best: Best, rows: list[tuple]) -> None:
    """Ranks the documents of segments, those with the highest bounds first."""
    found = []
    for m, docs, terms, ends, tfs, places in rows:
        if not len(docs):
            continue
        q, t = _present(terms, items.terms)
        start = np.append(0, ends[:-1])[t].astype(np.int64)
        kinds, kind = np.unique(tfs, return_inverse=True)
        impact = (10**9 * kinds.astype(np.int64)) // (1000 * kinds.astype(np.int64) + 8 * m)  # once for each tf
        top = np.zeros(len(items.terms), np.int64)
        top[q] = impact[kind[start]]
        found.append((np.add.reduceat(items.weights * top[items.cols], items.ptr[:-1]), docs, q, start, ends[t].astype(np.int64), impact, kind, places))
    for bound, docs, q, start, end, impact, kind, places in sorted(found, key=lambda x: -int(x[0].max())):
        live = np.flatnonzero(bound >= best.least)
        if not len(live):
            continue
        size = end - start
        flat = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
        of = np.full(len(items.terms), -1)
        of[q] = np.arange(len(q))
        weights, impacts = (np.zeros(shape, np.float64 if exact else np.int64) for shape in ((len(live), len(q)), (len(q), len(docs))))
        impacts[np.repeat(np.arange(len(q)), size), places[flat]] = impact[kind[flat]]
        for k, item in enumerate(live.tolist()):
            own = slice(items.ptr[item], items.ptr[item + 1])
            col = of[items.cols[own]]
            weights[k, col[col >= 0]] = items.weights[own][col >= 0]
        scores = weights @ impacts
        for k in np.flatnonzero(scores.max(axis=1) >= best.least[live]).tolist():
            own = np.flatnonzero(scores[k] >= best.least[live[k]])
            best.add(int(live[k]), docs[own], scores[k][own].astype(np.int64))


def search(index: Index, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each of ``items(item_id, text)``, fewer if fewer score."""
    spark, out = index.segments.sparkSession, None
    for block in _blocks(items):
        df = document_frequencies(index, block.terms).tolist()
        w = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * d + 1))) for d in df], np.int64)
        block.weights = block.weights * w[block.cols]
        if not block.ids:
            continue
        exact = int(np.add.reduceat(block.weights, block.ptr[:-1]).max()) * 10**6 < EXACT
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, exact=exact) -> Iterator[pa.RecordBatch]:
            items = shared.value
            best = Best(len(items.ids), k)
            for b in batches:
                _visit(items, exact, best, list(zip(b.column("m").to_pylist(), *_columns(b, "docs", "terms", "ends", "tfs", "places"))))
            item = np.repeat(np.arange(len(items.ids)), [len(d) for d in best.docs])
            yield pa.RecordBatch.from_arrays([pa.array(item), *(pa.array(np.concatenate([*x, np.empty(0, np.int64)])) for x in (best.docs, best.scores))], names=["item", "doc_id", "score"])

        found = index.segments.mapInArrow(run, "item long, doc_id long, score long")
        order = [F.desc("score"), F.asc("doc_id")]
        first = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= k)
        last = first.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, item in enumerate(block.ids)], "item long, item_id long")
        ranked = last.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
