"""WARC archives as a chunked record table.

Writing: each task writes one archive file of gzip members, a record each, payloads compressed piece by piece; the file
gets its final name when it is whole, so a repeated task replaces it. Reading: an archive is streamed in blocks and
every payload comes out as rows (record_id, chunk_no, chunk, bytes_so_far, digest_so_far): the digest is carried on
from chunk to chunk, the last row's is that of the payload, and no record is held whole, whatever its length.

Files are opened with pyarrow's file systems from the URI in ``spark.checkpoint.dir``, which all executors share.

Nulls: a null payload is empty, a null URI is written as "-"; a row with a null page_id is a response of its own, named
"none", which no other revisits. Repeated page_ids give a record each, with the payload of its own row; rows that repeat
both the largest page_id and the payload are responses each. An empty table writes no archive and reads as no row. Other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .util import new_path, stage

BLOCK = 1 << 18
CHUNKS = "record_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk_no int, chunk binary, bytes_so_far long, digest_so_far string"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _uri(path: str) -> str:
    """file:/x (as Spark writes it) and file:///x alike."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def choose_records(pages: DataFrame, payload: str = "html", least: int = 1000) -> DataFrame:
    """(page_id, n_bytes, digest, refers_to) : of equal payloads of ``least`` bytes or more, the largest page_id is the response.

    A digest that occurs once never reaches the join; a hot one has one row on the small side, so the join may split it.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    sums = stage(pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(body).cast("long").alias("n_bytes"), F.sha1(body.cast("binary")).alias("digest")), "warc-digests")
    last = sums.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "refers_to")
    return sums.join(last, "digest", "left").withColumn("refers_to", F.when((F.col("n_bytes") >= least) & (F.col("refers_to") != F.col("page_id")), F.col("refers_to"))).select("page_id", "n_bytes", "digest", "refers_to")


def write_archives(pages: DataFrame, payload: str = "html", least: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes the archives; returns the manifest (path, records, bytes), a row a file.

    Only revisits are joined to the pages (on page_id and digest, as a page_id may occur with several payloads); that is
    the one shuffle of payloads, and none if they are few.
    """
    spark = pages.sparkSession
    folder = _uri(folder or new_path(spark, "warc"))
    revisits = choose_records(pages, payload, least).where("refers_to is not null").select("page_id", "digest", "refers_to").distinct()
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), *([F.col("url").cast("string").alias("url")] if "url" in pages.columns else [F.lit(None).cast("string").alias("url")]), F.col(payload).cast("string").alias("body"), F.sha1(body.cast("binary")).alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "body", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, root = _open(folder)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
        out, records = None, 0
        for b in batches:
            if out is None and b.num_rows:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(own, compression=None)
            ids, urls, bodies, refs = b.column("page_id").to_pylist(), b.column("url").to_pylist(), b.column("body"), b.column("refers_to").to_pylist()
            for i, (page, url, ref) in enumerate(zip(ids, urls, refs)):
                write_record(out, page, url, bodies[i].as_buffer() if bodies[i].is_valid else b"", ref)
            records += b.num_rows
        if out is not None:
            out.close()
            store.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([records], pa.int64()), pa.array([store.get_file_info(name).size], pa.int64())], names=["path", "records", "bytes"])

    return stage(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def write_record(out, page: int | None, url: str | None, body, refers_to: int | None) -> None:
    """One gzip member: headers, then the payload block by block, unless it revisits another record."""
    view = memoryview(body)
    sha = hashlib.sha1(view)
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page is None else page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '-').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}",
        f"X-Payload-Length: {len(view)}",
    ]
    if refers_to is not None:
        headers += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        view = view[:0]
    headers += ["Content-Type: text/html", f"Content-Length: {len(view)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out.write(z.compress("\r\n".join(headers).encode()))
    for at in range(0, len(view), BLOCK):
        out.write(z.compress(view[at : at + BLOCK]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


def _plain(source) -> Iterator[bytes]:
    """Blocks of an archive's bytes, inflated member by member, each of at most BLOCK bytes."""
    z = zlib.decompressobj(31)
    while raw := source.read(BLOCK):
        while raw:
            if data := z.decompress(raw, BLOCK):
                yield data
            if z.eof:
                raw, z = z.unused_data, zlib.decompressobj(31)
            else:
                raw = z.unconsumed_tail
    while data := z.decompress(z.unconsumed_tail, BLOCK):
        yield data


def read_records(source, chunk: int) -> Iterator[tuple]:
    """Rows of CHUNKS from an open archive; a record without payload gives one row with an empty chunk."""
    blocks, held = _plain(source), bytearray()

    def more() -> bool:
        data = next(blocks, None)
        held.extend(data or b"")
        return data is not None

    while True:
        while (at := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record")
                return
        head = dict(x.split(": ", 1) for x in held[:at].decode().split("\r\n")[1:])
        del held[: at + 4]
        page, ref = (None if x == "none" else int(x) for x in (head.get(k, "none").removeprefix("<urn:page:").removesuffix(">") for k in ("WARC-Record-ID", "WARC-Refers-To")))
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        left, so_far, k, sha = int(head["Content-Length"]), 0, 0, hashlib.sha1()
        while True:
            n = min(chunk, left)
            while len(held) < n:
                if not more():
                    raise ValueError("the archive ends within a payload")
            piece = bytes(held[:n])
            del held[:n]
            sha.update(piece)
            left, so_far = left - n, so_far + n
            yield page, head["WARC-Type"], ref, int(head["X-Payload-Length"]), digest, k, piece, so_far, sha.hexdigest()
            k += 1
            if not left:
                break
        while len(held) < 4:
            if not more():
                raise ValueError("the archive ends within a record")
        if held[:4] != b"\r\n\r\n":
            raise ValueError("no end of record where its length says")
        del held[:4]


def read_archives(spark: SparkSession, manifest: DataFrame, chunk: int = 1 << 16, with_chunks: bool = True) -> DataFrame:
    """The chunked record table of all archives of a manifest; a task streams whole files, a batch holds about 4 MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in CHUNKS.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for path in b.column("path").to_pylist():
                store, at = _open(path)
                with store.open_input_stream(at, compression=None) as source:
                    rows, size = [], 0
                    for r in read_records(source, chunk):
                        rows.append(r if with_chunks else (*r[:6], b"", *r[7:]))
                        size += len(rows[-1][6]) + 200
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, CHUNKS)


def payloads(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the chunk table, its digests verified.

    A record's last chunk carries the whole digest, so no group is formed and no payload is put together.
    """
    last = F.col("bytes_so_far") == F.when(F.col("record_type") == "response", F.col("declared_bytes")).otherwise(F.lit(0))
    sound = (F.col("record_type") == "revisit") | (F.col("digest_so_far") == F.col("declared_digest"))
    digest = F.when(sound, F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ in record "), F.col("record_id").cast("string"))).cast("string"))
    return chunks.where(last).select(F.col("record_id").alias("page_id"), F.col("declared_bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
