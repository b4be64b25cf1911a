"""The embedding stage: what has no vector under a model yet, in batches, through any function from texts to vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BATCH = 32
Embedder = Callable[[list[str]], np.ndarray]
WORD = re.compile(r"[^a-z0-9]+")


def hashed_words(dim: int) -> Embedder:
    """A deterministic bag of words: those of four letters or more, each counted in the place of its hash; 1 in place 0 if none."""
    memo: dict[str, int] = {}

    def place(word: str) -> int:
        if word not in memo:
            h = 7
            for c in word:
                h = (h * 31 + ord(c)) % 100_003
            memo[word] = h % dim
        return memo[word]

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            for w in WORD.split(text.lower()):
                if len(w) >= 4:
                    row[place(w)] += 1
            if not row.any():
                row[0] = 1
        return out

    return embed


def embed_missing(texts: DataFrame, held: DataFrame | None, model: str, embedder: Embedder, dim: int, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, model, embedding array<float>) of the rows whose (key, model) is not in ``held``; to be appended there.

    The backlog is an anti-join, so a repeated run embeds nothing. Vectors of another width or with a number that is not
    finite are refused. A null text is embedded as an empty one.
    """
    todo = texts.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if held is not None:
        todo = todo.join(held.where(F.col("model") == model).select(F.col(key).alias("key")).distinct(), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BATCH):
                some = b.slice(at, BATCH)
                v = np.asarray(embedder(some.column("text").to_pylist()), dtype=np.float32)
                if v.shape != (some.num_rows, dim) or not np.isfinite(v).all():
                    raise ValueError(f"the embedder gave {v.shape}, finite: {bool(np.isfinite(v).all())}; expected {(some.num_rows, dim)}")
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column("key"), flat], names=["key", "embedding"])

    kind = todo.schema["key"].dataType.simpleString()
    return todo.mapInArrow(run, f"key {kind}, embedding array<float>").select(F.col("key").alias(key), F.lit(model).alias("model"), "embedding")
