"""Concatenate and cut: documents end to end, cut into windows of fixed length.

Pass one encodes each partition and stages its ids with their place in the partition; the partitions' totals, summed in
order, give every document its global offset. Pass two cuts at multiples of the window and records the pieces.

Nulls: a null text is empty and packs as its end id; a null doc_id stays null. Repeated rows are packed each. An empty
table gives no piece. Padding: the last window alone is not full. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .token_files import encode_partitions, list_slices, read_token_files, save
from .util import frugal, new_path, stage

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, lead: bool = False, end_id: int = 2, window: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``; ``with_ids`` adds each piece's ids, to be grouped by sequence_id when written."""
    spark = docs.sparkSession
    path = save(encode_partitions(docs, tokenizer, lead, end_id), new_path(spark, "pack-ids"))
    schema = PIECES + (", ids array<int>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, first = (b.column(c).to_numpy() for c in ("n_tokens", "start"))
            off, raw = list_slices(b.column("ids"))
            seq0, seq1 = first // window, (first + n - 1) // window
            k = (seq1 - seq0 + 1).astype(np.int64)
            row = np.repeat(np.arange(len(n)), k)
            seq = seq0[row] + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            lo = np.maximum(seq * window, first[row])
            hi = np.minimum((seq + 1) * window, first[row] + n[row])
            at = off[row] + lo - first[row]
            to = at + hi - lo
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at.tolist(), to.tolist())]
            out = [b.column("doc_id").take(pa.array(row)), *map(pa.array, (lo - first[row], hi - lo)), pa.array(crc, pa.int64()), *map(pa.array, (n[row], seq, lo - seq * window))]
            if with_ids:
                flat = np.frombuffer(raw, dtype="<i4")
                lists = [flat[i:j] for i, j in zip(at.tolist(), to.tolist())]
                out.append(pa.array(lists, type=pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    out = read_token_files(spark, path).mapInArrow(cut, schema)
    return out if with_ids else stage(out, "pieces")  # here, where batches are small; pieces without ids take few bytes
