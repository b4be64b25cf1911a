"""Helpers shared by the operators: the shared folder, staged tables, bounded sketches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.batches import frugal, give_back, kept, pieces  # noqa: F401


def lower_ascii(text: str) -> str:
    """A-Z in lower case; other letters stay."""
    return text.encode().lower().decode()


def lower_words(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z in lower case, as UTF-8: bytes know ASCII case and white space only."""
    return text.encode().lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where none is named, a local session gets a folder under /tmp, made and set once; a cluster is refused, as its
    executors would each write to a disk of their own.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = "file://" + tempfile.mkdtemp(prefix="lectern-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Arrow batches of about ``size`` bytes while the block runs, as rows hold whole texts; then the session is as it was."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there, and a lost executor costs a re-read only."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def discard(*staged: DataFrame) -> None:
    """Deletes tables that ``stage`` wrote, once nothing that is still to run reads them."""
    for df in staged:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str, *others: str) -> str:
    """A column name that neither ``df`` nor ``others`` has, whatever their case: ``name`` between underscores, more of them if need be."""
    taken, out = {c.lower() for c in (*df.columns, *others)}, f"__{name}"
    while out.lower() in taken:
        out = "_" + out
    return out


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column's values, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def bitmap(df: DataFrame, column: str, bits: int = 1 << 23) -> np.ndarray:
    """A bitmap of fixed size over a long column: bit ``pmod(value, bits)`` is set for every value.

    At most ``bits / 63`` rows reach the driver whatever the input, so the result may be broadcast. Membership can be
    falsely true, never falsely false: callers use it to skip work, and decide by a join or a comparison.
    """
    slot = F.pmod(F.col(column), F.lit(bits))
    some = (
        df.where(F.col(column).isNotNull())
        .groupBy((slot / F.lit(63)).cast("long").alias("w"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(pmod({column}, {bits}L), 63L) as int))")).alias("m"))
    )
    with small_batches(df.sparkSession):
        words = some.toPandas()
    out = np.zeros((bits + 62) // 63, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["m"].to_numpy(dtype=np.int64)
    return out


def in_bitmap(words: np.ndarray, values: np.ndarray, bits: int = 1 << 23) -> np.ndarray:
    slot = np.mod(values.astype(np.int64, copy=False), bits)
    return (words[slot // 63] >> (slot % 63)) & 1 == 1


class WordHashes(dict):
    """64-bit hashes of words, as signed integers, kept for the next text; emptied at ``keep`` entries."""

    def __init__(self, keep: int = 200_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str | bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        h = self[word] = h - (1 << 64) if h >> 63 else h
        return h

    def of(self, words: list[str] | list[bytes]) -> np.ndarray:
        if len(self) > self.keep:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def byte_codes(between: list[int], lower: bool = True) -> np.ndarray:
    """Of each byte its number, that of the lower-case letter if ``lower``, and 0 for the bytes that stand between words."""
    return np.array([0 if k in between else xxhash.xxh64_intdigest(bytes([k]).lower() if lower else bytes([k]), seed=12) for k in range(256)], dtype=np.uint64)


BLANKS = [0x20, *range(0x09, 0x0E)]
_CODES = byte_codes(BLANKS)
#: Odd multipliers of the places in a word; a place from 4096 on adds an even number to that of its low bits.
_PLACES = np.array([xxhash.xxh64_intdigest(k.to_bytes(2, "little"), seed=13) | 1 for k in range(4096)], dtype=np.uint64)


def word_starts(column: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, where each text begins among them and the last one ends, and where each word begins."""
    texts = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    at = at - at[0]
    inside = (codes != 0)[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    return raw, at, starts


def word_hashes(raw: np.ndarray, starts: np.ndarray, codes: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """64-bit hashes of the words that begin at ``starts``, each up to the next one."""
    h = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(raw), block):
            high = min(low + block, len(raw))
            i, j = max(int(np.searchsorted(starts, low, "right")) - 1, 0), int(np.searchsorted(starts, high))
            if i == j:
                continue
            own = np.maximum(starts[i:j], low)
            place = np.arange(own[0], high) - np.repeat(starts[i:j], np.diff(own, append=high))
            factors = _PLACES[place] if place.max() < 4096 else _PLACES[place & 4095] + ((place >> 12) * 0x9E3779B9 << 1).astype(np.uint64)
            h[i:j] += np.add.reduceat(codes[raw[own[0] : high]] * factors, own - own[0])
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


def hashed_words(column: pa.Array, block: int = 1 << 16, codes: np.ndarray = _CODES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a string column, those of ``lower_words`` unless ``codes`` are others, text after text,
    and each text's number of words.

    A word's hash is the sum of its bytes' numbers times odd factors by place, mixed. Words that differ in one byte never
    share a sum. The sums are array operations on blocks of bytes, also where a word crosses blocks, so that a long text
    takes a few bytes of memory for each of its own. A null has no words.
    """
    raw, at, starts = word_starts(column, codes)
    return word_hashes(raw, starts, codes, block), np.diff(np.searchsorted(starts, at))


#: Odd multipliers of the positions of a window, from one seed.
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([k]), seed=11) | 1 for k in range(64)], dtype=np.uint64)


def window_sums(tokens: np.ndarray, masks: list[tuple[int, str]]) -> dict[int, np.ndarray]:
    """For each (salt, mask) a hash of every window of len(mask) tokens, over one array of the tokens of many texts.

    A window's hash is a sum of its tokens times odd factors, by position; places with 0 in the mask are left out.
    """
    t, out, products = tokens.view(np.uint64), {}, {}
    with np.errstate(over="ignore"):
        for salt, mask in masks:
            n = len(t) - len(mask) + 1
            if n <= 0:
                out[salt] = np.empty(0, dtype=np.int64)
                continue
            h = np.full(n, np.uint64(salt) * _FACTORS[63], dtype=np.uint64)
            for k, bit in enumerate(mask):
                if bit == "1":
                    if k not in products:
                        products[k] = t * _FACTORS[k]
                    h += products[k][k : k + n]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            out[salt] = h.view(np.int64)
    return out
