"""Exact cosine search of a table of questions over vectors as they come, and backgrounds over all vectors in one pass.

Vectors are packed batch by batch, a person's beside each other, without a shuffle, and searched as ``cells`` are: as matrix
products, with at most ``k`` answers a question from each batch. A table that is asked often is stored in cells instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import cells
from .cells import unit_rows

#: Questions that are broadcast; more are packed by person and joined.
BLOCK = cells.BLOCK


def score(questions: DataFrame, chunks: DataFrame, k: int | None = None, own: bool = False) -> DataFrame:
    """PAIRS of each question and the chunks of its person: all of them, or the nearest ``k`` with their rank ``r``.

    ``questions`` has (q_id, person, q_vec), ``chunks`` (chunk_id, person, item, ordinal, embedding). A question's dates
    ``since`` and ``until``, both inclusive, bound ``published_at`` of the chunks, and leave out undated ones, where given.
    Unless ``own`` is set, the chunk with the id of the question is left out. Nulls: a null vector, or one that has not the
    length of a question's, has the cosine 0; rows with a null person or id meet none. No questions or chunks give no row.
    """
    return cells.search(chunks, questions, k, own=own, block=BLOCK, raw=True)


def mean_directions(vectors: DataFrame, key: str = "label", column: str = "embedding") -> DataFrame:
    """(key, i, total, n): the sum of the unit vectors of each key by dimension, and their number, with partial sums.

    The mean cosine of a statement to many probes is its unit vector times the mean of theirs, so a background over all
    vectors takes one pass over them, and no pair is formed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, u = b.column("key").to_numpy(), unit_rows(b.column("v"))
            for k in np.unique(keys).tolist() if u.shape[1] else []:
                s = u[keys == k].sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(np.arange(len(s))), pa.array(s), pa.array(np.full(len(s), int((keys == k).sum())))], names=["key", "i", "total", "n"])

    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(column).alias("v")).where("key is not null")
    return rows.mapInArrow(run, "key long, i long, total double, n long").groupBy("key", "i").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def background(statements: DataFrame, vectors: DataFrame, others_only: bool) -> DataFrame:
    """(position, background): the mean cosine of each statement (position, person, s_vec) to all vectors, or to those of
    other people, rounded to three places; 0 where there are none."""
    sums = mean_directions(vectors)
    whole = sums.groupBy("i").agg(F.sum("total").alias("all_total"), F.sum("n").alias("all_n"))
    own = sums.select(F.col("key").alias("person"), "i", F.col("total").alias("own_total"), F.col("n").alias("own_n"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit_rows(b.column("s_vec"))
            yield pa.RecordBatch.from_arrays([b.column("position"), b.column("person"), pa.array(list(u), pa.list_(pa.float64()))], names=["position", "person", "u"])

    dims = statements.select(F.col("position").cast("long"), F.col("person").cast("long"), "s_vec").mapInArrow(unit, "position long, person long, u array<double>").select("position", "person", F.posexplode("u").alias("i", "x"))
    both = dims.join(F.broadcast(whole), "i").join(own, ["person", "i"], "left")  # whole has a row a dimension
    less = (lambda c: F.coalesce(F.col(c), F.lit(0))) if others_only else (lambda c: F.lit(0))
    n = F.max(F.col("all_n") - less("own_n"))
    mean = F.sum(F.col("x") * (F.col("all_total") - less("own_total")))
    return both.groupBy("position").agg(F.when(n > 0, F.floor(mean / n * 1e3 + 0.5) / 1e3).otherwise(F.lit(0.0)).alias("background"))
