"""Token-ID files: Parquet lists of ids in document order, with small row groups, page indexes and chosen encodings.

Each file row holds ``doc_id``, ``part`` (ordinal of its file), ``local_start`` (ids before it in that file),
``n_tokens`` and ``ids``. Spark's writer keeps column and offset indexes; ids are dictionary-encoded (a vocabulary of
50,000 fits one dictionary page), the sorted longs are delta-encoded (format version 2). A reader that asks for
``doc_id, n_tokens`` never touches the ids, and a range of doc_id reads only the pages that hold it.

Nulls: a null text is empty (its end id alone); rows with a null doc_id come first. Repeated doc_ids each keep their
row, ordered by text. An empty table gives no row. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .tokens import encoder
from .util import give_back, new_path, pieces, small_batches, stage

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def encode_partitions(docs: DataFrame, tokenizer: str, lead: bool, end_id: int) -> DataFrame:
    """Rows of FILE_SCHEMA from (doc_id, text), in the order in which each partition holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer, lead)
        for b in pieces(batches, "text", limit=1 << 20):
            ids, n = enc.ids(b.column("text"))
            n += 1
            upto = np.cumsum(n)
            flat = np.full(len(ids) + len(n), end_id, np.int32)
            kept = np.ones(len(flat), bool)
            kept[upto - 1] = False
            flat[kept] = ids
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").cast(pa.int64()), pa.array(np.full(len(n), part, np.int32)), pa.array(at + upto - n), pa.array(n), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(flat))],
                names=["doc_id", "part", "local_start", "n_tokens", "ids"],
            )
            at += int(upto[-1]) if len(n) else 0
            pa.default_memory_pool().release_unused()
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FILE_SCHEMA)


def save(rows: DataFrame, path: str, row_group: int = 16 << 20, page_rows: int = 256) -> str:
    """Writes rows of FILE_SCHEMA with Spark's committer: a lost task is written again, never twice."""
    written = (
        rows.write.option("parquet.block.size", row_group)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("compression", "zstd")
    )
    with small_batches(rows.sparkSession):
        written.parquet(path)
    return path


def write_token_files(docs: DataFrame, tokenizer: str, lead: bool = True, end_id: int = 2, path: str | None = None) -> str:
    """Encodes ``docs(doc_id, text)`` and writes token files in ascending doc_id order; returns their folder."""
    path = path or new_path(docs.sparkSession, "token-files")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return save(encode_partitions(ordered, tokenizer, lead, end_id), path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, base): ids before each file. Reads two small columns; one row a file, so the running sum is over few rows."""
    parts = spark.read.schema(FILE_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("part", before.alias("base"))


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(doc_id, start, n_tokens, *columns): ``start`` is global. Ask for no columns to read metadata alone."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    starts = stage(part_starts(spark, path), "part-starts")  # written, so that the planner knows how small it is and leaves the ids where they are
    return rows.join(starts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def list_slices(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and the bytes of an int32 list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    return off, memoryview(np.ascontiguousarray(flat).view(np.uint8))


def with_crc32(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of (doc_id, start, n_tokens, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, raw = list_slices(b.column("ids"))
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(off, off[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
