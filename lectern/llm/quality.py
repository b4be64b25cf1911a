"""Quality rules with cross-document line frequency.

Lines are normalised (words joined by one blank, A-Z lower-cased) and hashed. Per host (the ``source`` column) each
line's distinct documents are counted. With ``texts_once`` exact copies of a text count as one document, for callers that
remove copies later: copying a document then does not turn its own lines into boilerplate. Lines of any length in more
than ``limit`` documents of a host are removed from all of that host's documents. A document is rejected when its base
rules fail, or when it is depleted: fewer than ``keep_share`` per cent of its words stay.

Nulls: a null text has no words and fails the base rules; null hosts are one host; a null doc_id stays null, and its
documents are told apart by their texts. Repeated rows (doc_id and text) count once and are judged each, with the same
verdict. An empty table gives no row. Other columns, whatever their names, are kept by ``clean`` and not read by ``judge``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .util import frugal, lower_words, pieces, stage, text_column

LIMIT, KEEP_SHARE = 20, 50
#: Frequent lines that may be broadcast (8 bytes each); beyond it they are joined.
BROADCAST = 1_000_000
SYMBOLS = re.compile(r"[#*$%&|<>]")
WHITE = "\t\n\x0b\x0c\r "
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def line_keys(text: str, host: str | None) -> list[tuple[int, int, str]]:
    """(key, words, line) of each line that has words."""
    seed = 42 if host is None else xxhash.xxh64_intdigest(host.encode(), seed=42)
    out = []
    for line in text.split("\n"):
        w = lower_words(line)
        if w:
            out.append((xxhash.xxh64_intdigest(b" ".join(w), seed=seed), len(w), line))
    return out


def base_metrics(text: str) -> tuple[int, int, int, int, int, bool]:
    w = text.encode().split()
    n = len(w)
    lines = [x for x in text.split("\n") if x and (not x.isspace() or x.encode().split())]
    repeated = 0
    if n >= 3:
        seen = Counter(zip(w, w[1:], w[2:]))
        if len(seen) < n - 2:
            hit = np.fromiter((seen[x] > 1 for x in zip(w, w[1:], w[2:])), dtype=bool, count=n - 2)
            cover = np.zeros(n, dtype=bool)
            for k in range(3):
                cover[k : n - 2 + k] |= hit
            repeated = int(cover.sum())
    return n, len(text) - sum(map(text.count, WHITE)), len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeated, n < 50 or 100 * repeated > 50 * n


def _signed(keys) -> np.ndarray:
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _own_keys(b: pa.RecordBatch, name: str) -> pa.RecordBatch:
    """(line_key, name): the distinct line keys of each text of a batch, with the text's value of a long column."""
    per = [list({k for k, _, _ in line_keys(t, h)}) for t, h in zip(text_column(b, "text"), b.column("host").to_pylist())]
    return pa.RecordBatch.from_arrays([pa.array(_signed([k for x in per for k in x])), pa.array(np.repeat(b.column(name).to_numpy(), [len(x) for x in per]))], names=["line_key", name])


def frequent_lines(docs: DataFrame, limit: int = LIMIT, texts_once: bool = False) -> DataFrame:
    """(line_key): lines in more than ``limit`` distinct documents of a host. The hash of a line includes its host.

    Two steps, so that a line of a third of all documents is spread: distinct (line, document) first, then counts with
    partial sums before the shuffle.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield _own_keys(b, "fp")

    lines = docs.select("text", F.col("source").cast("string").alias("host"), F.xxhash64(*([] if texts_once else ["doc_id"]), "text").alias("fp")).where("text is not null").mapInArrow(run, "line_key long, fp long")
    return lines.distinct().groupBy("line_key").count().where(F.col("count") > limit).select("line_key")


def _judged(docs: DataFrame, columns: list[str], frequent: DataFrame, limit: int, keep_share: int, with_text: bool) -> DataFrame:
    """The columns of ``docs`` that are named, as c0, c1 and so on, with METRICS, ``n_removed_words``, ``kept`` and, if asked, ``cleaned``."""
    spark = docs.sparkSession
    few = frequent.limit(BROADCAST + 1).count() <= BROADCAST
    keys = np.sort(frequent.toPandas()["line_key"].to_numpy(dtype=np.int64)) if few else None
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], F.col("text"), F.col("source").cast("string").alias("host"))
    rows = kept.withColumn("gone", F.lit(None).cast("array<long>")) if few else _with_gone(kept, frequent)
    shared = spark.sparkContext.broadcast(keys)
    schema = StructType([*kept.schema.fields[: len(columns)], *StructType.fromDDL(METRICS + ", n_removed_words long, kept boolean" + (", cleaned string" if with_text else "")).fields])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        for b in pieces(batches, "text"):
            out, cleaned = [], []
            for t, h, gone in zip(text_column(b, "text"), b.column("host").to_pylist(), b.column("gone").to_pylist()):
                m = base_metrics(t)
                lines = line_keys(t, h)
                own = _signed([x[0] for x in lines])
                if keys is None:
                    hit = np.isin(own, np.array(gone or [], dtype=np.int64))
                else:
                    at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                    hit = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
                removed = sum(x[1] for x, y in zip(lines, hit) if y)
                out.append((*m, removed, not m[5] and 100 * (m[0] - removed) >= keep_share * m[0]))
                if with_text:
                    lost = {x[2] for x, y in zip(lines, hit) if y}
                    cleaned.append("\n".join(x for x in t.split("\n") if x not in lost) if lost else t)
            cols = [b.column(f"c{i}") for i in range(len(columns))] + [pa.array(c, pa.bool_() if k in (5, 7) else pa.int64()) for k, c in enumerate(zip(*out) if out else [()] * 8)]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(cleaned, pa.string())] * with_text, names=schema.names)

    return rows.mapInArrow(run, schema)


def _with_gone(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """Beyond the broadcast bound: each text's frequent lines by a join on the line, then on the text's hash."""
    keyed = rows.withColumn("fp", F.xxhash64("text", "host"))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            yield _own_keys(b, "fp")

    gone = keyed.select("text", "host", "fp").mapInArrow(run, "line_key long, fp long").distinct().join(frequent, "line_key").groupBy("fp").agg(F.collect_set("line_key").alias("gone"))
    return keyed.join(gone, "fp", "left").drop("fp")


def judge(docs: DataFrame, limit: int = LIMIT, keep_share: int = KEEP_SHARE, texts_once: bool = False) -> DataFrame:
    """(doc_id, METRICS, n_removed_words, kept), a row for each of ``docs(doc_id, text, source)``."""
    frequent = stage(frequent_lines(docs, limit, texts_once), "frequent-lines")
    return _judged(docs, ["doc_id"], frequent, limit, keep_share, False).withColumnRenamed("c0", "doc_id")


def clean(docs: DataFrame, limit: int = LIMIT, keep_share: int = KEEP_SHARE, texts_once: bool = False) -> DataFrame:
    """The documents kept, with all their columns, frequent lines removed from ``text``."""
    frequent = stage(frequent_lines(docs, limit, texts_once), "frequent-lines")
    others = [c for c in docs.columns if c != "text"]
    out = _judged(docs, others, frequent, limit, keep_share, True).where("kept")
    return out.select(*[F.col("cleaned").alias("text") if c == "text" else F.col(f"c{others.index(c)}").alias(c) for c in docs.columns])
