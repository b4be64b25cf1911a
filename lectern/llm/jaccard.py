"""Exact similarity join of shingle sets: size-banded tiles, bitmap bounds, then sorted-array intersection.

* A document's set holds the distinct hashes of its five-word shingles (64 bits). Equal sets form one class.
* A set's shingles are put in one global order; two sets with a Jaccard similarity of at least ``share`` per cent have a
  shingle in common among the first ``n - ceil(share * n / 100) + 1`` of each. A tile holds the sets that have one such
  shingle, in order of size; only sets whose sizes differ by less than the factor meet (the size band), and only where
  the place of the shingle in both still allows enough overlap. The largest size that a set can meet from its place is
  its reach; sets of a tile that is not common, whose reaches leave them no partner there, are not stored.
* The order puts shingles of many documents last, so that common lines and passages form no tiles. They are found in
  one of 32 documents and kept as a bitmap of fixed size. Any order gives the same links: this one decides the cost alone.
* Pairs are first bounded by hashed bitmaps in which each shingle flips one bit: the sets differ in at least as many
  shingles as the bitmaps differ in bits. What passes is decided by intersecting the sorted arrays.
* Groups of thousands of near copies aren't expanded. First each set is compared with the smallest of its size band and
  with its neighbour in size, of the tiles it shares most of with them, and what links is joined. Then tiles that still
  hold several components are gone through: a set there meets all smaller ones of other components that its bitmap
  leaves, or, where these are more than FEW, the nearest alone, and its tile stays open. Open tiles are gone through
  again with the components of that time, the last time without a bound. A pair left out is already connected, so no
  link between components is lost.
* A tile of a common shingle is dealt over SALTS parts to find neighbours, and compared in cells of about CELL sets a
  side, so that no task holds the tile of a shingle that a third of the documents share.

Nulls: a null text, or one without words, has an empty set and links with nothing; a null doc_id takes part and its
component is the smallest doc_id it reaches, else null. Repeated rows are equal sets, so they link. Rows that share a
doc_id but not a text are sets of their own: each has the component that its text reaches, and none joins another's.
Texts of fewer than five words are one shingle. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .components import components
from .util import bitmap, discard, frugal, hashed_words, in_bitmap, pieces, stage, unused, window_sums

WIDTH, SHARE = 5, 80
#: One of SAMPLE documents shows which shingles are common: those of at least COMMON of them.
SAMPLE, COMMON = 32, 3
#: Partners of other components that a set meets in a tile before its tile is left open; sets a side of a cell; parts of a common tile.
FEW, CELL, SALTS = 8, 2048, 64
#: Bytes of text of which a task holds the shingles at once: word and window hashes take some twenty times as many.
SLICE = 1 << 20


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    every, counts = hashed_words(texts)
    sums = window_sums(every, [(1, "1" * width)])[1]
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(sums[at : at + n - width + 1]))
        elif n:
            out.append(window_sums(every[at : at + n], [(1 + n, "1" * n)])[1 + n])
        else:
            out.append(np.empty(0, np.int64))
        at += n
    return out


def prefix_length(n: int, share: int) -> int:
    return n - -(-share * n // 100) + 1


def _order(a: np.ndarray) -> np.ndarray:
    """The hash by which shingles are ordered; other bits than those that the arrays are sorted by."""
    with np.errstate(over="ignore"):
        x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(31))


def _fingerprint(a: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(a.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def common_shingles(docs: DataFrame) -> np.ndarray:
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", limit=SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*shingle_sets(b.column("text")), np.empty(0, np.int64)]))], names=["key"])

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).dropDuplicates(["text"]).select("text")
    return bitmap(some.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= COMMON), "key")


def sketch(a: np.ndarray) -> bytes:
    """A bitmap in which each element flips one bit; more bits for larger sets, in powers of two."""
    bits = 1024 if len(a) < 2048 else 4096 if len(a) < 8192 else 16384 if len(a) < 32768 else 65536
    flips = np.bincount((_order(a) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def words_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their bitmaps as 64-bit words) of each length of bitmap in a binary column."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4) // 8
    flat, lengths = np.frombuffer(data, np.uint64, at[-1]) if len(column) else np.empty(0, np.uint64), np.diff(at)
    return [(rows, flat[at[rows][:, None] + np.arange(w)]) for w in np.unique(lengths).tolist() for rows in [np.flatnonzero(lengths == w)]]


class Bitmaps:
    """The bitmaps of a batch; pairs of rows are bounded at once, the longer bitmap of a pair folded onto the shorter."""

    def __init__(self, column: pa.Array):
        self.words, self.kind, self.slot = [], np.zeros(len(column), np.int8), np.zeros(len(column), np.int64)
        for k, (rows, words) in enumerate(words_of(column)):
            self.words.append(words)
            self.kind[rows], self.slot[rows] = k, np.arange(len(rows))

    def least_difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bounds from below of the sizes of the symmetric differences of the sets of rows i and j."""
        out = np.zeros(len(i), np.int64)
        kinds = self.kind[i].astype(np.int64) * len(self.words) + self.kind[j]
        for k in np.unique(kinds).tolist():
            own = np.flatnonzero(kinds == k)
            a, b = self.words[k // len(self.words)], self.words[k % len(self.words)]
            w = min(a.shape[1], b.shape[1])
            step = max(1, (1 << 20) // max(a.shape[1], b.shape[1]))  # bounded memory, however many pairs
            for low in range(0, len(own), step):
                some = own[low : low + step]
                x, y = (m[self.slot[r[some]]].reshape(len(some), -1, w) for m, r in ((a, i), (b, j)))
                out[some] = np.bitwise_count(np.bitwise_xor.reduce(x, axis=1) ^ np.bitwise_xor.reduce(y, axis=1)).sum(axis=1, dtype=np.int64)
        return out


SETS = "doc_id long, rep long, n int, hi long, lo long, sketch binary, keys array<long>, rare int"


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rep): ``rep`` stands for the row where one document of a class is read again."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rep", F.xxhash64("doc_id", "text"))


def document_sets(docs: DataFrame, common: np.ndarray, share: int) -> DataFrame:
    """A row of SETS for each document: ``sketch`` is its bitmap, ``keys`` are its tiles in order, the first ``rare`` of them not common."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", limit=SLICE):
            fps, keys, ns, sketches, rare = [], [], [], [], []
            for a in shingle_sets(b.column("text")):
                fps.append(_fingerprint(a))
                ns.append(len(a))
                sketches.append(sketch(a) if len(a) else None)
                k = prefix_length(len(a), share) if len(a) else 0
                rank = (_order(a) >> np.uint64(1)) | (in_bitmap(shared.value, a).astype(np.uint64) << np.uint64(63))
                first = np.argpartition(rank, k - 1)[:k] if 0 < k < len(a) else np.arange(k)
                first = first[np.argsort(rank[first], kind="stable")]
                keys.append(a[first])
                rare.append(int((rank[first] >> np.uint64(63) == 0).sum()))
            off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            tiles = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))
            own = [pa.array(x, t) for x, t in ((ns, pa.int32()), ([f[0] for f in fps], pa.int64()), ([f[1] for f in fps], pa.int64()), (sketches, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rep"), *own, tiles, pa.array(rare, pa.int32())], names=[x.split()[0] for x in SETS.split(", ")])

    return _rows(docs).mapInArrow(run, SETS)


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, share: int, bounded: bool) -> DataFrame:
    """Those of ``pairs(a, b)`` of classes whose sets are similar; ``bounded`` says that their bitmaps were compared already.

    The arrays of the pairs that the bitmaps leave are computed again, each from one document of its class.
    """

    @frugal
    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = Bitmaps(pa.concat_arrays([b.column("x"), b.column("y")]))
            n, m, at = (*(b.column(c).to_numpy().astype(np.int64) for c in "nm"), np.arange(b.num_rows))
            most = (n + m - both.least_difference(at, at + b.num_rows)) // 2
            yield b.select(["a", "b"]).filter(pa.array(100 * most >= share * (n + m - most)))

    @frugal
    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                both = np.concatenate([np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= share * (len(both) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends, rest = classes.select("cid", "n", "sketch"), pairs
    if not bounded:
        both = pairs.join(ends.toDF("a", "n", "x"), "a").join(ends.toDF("b", "m", "y"), "b")
        rest = pairs = stage(both.select("a", "b", "n", "m", "x", "y").mapInArrow(bound, "a long, b long"), "near")
    of = classes.select("cid", "hi", "lo", "rep")
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct().join(of, "cid"), "rep"))

    @frugal
    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(rep, hi, lo, data); a few documents that weren't asked for may come too, as ``wanted`` is a bitmap of hashes."""
        for b in pieces(batches, "text", limit=SLICE):
            b = b.filter(pa.array(in_bitmap(wanted.value, b.column("rep").to_numpy())))
            sets = shingle_sets(b.column("text"))
            fps = [_fingerprint(a) for a in sets]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array([f[0] for f in fps], pa.int64()), pa.array([f[1] for f in fps], pa.int64()), pa.array([a.tobytes() for a in sets], pa.binary())], names=["rep", "hi", "lo", "data"])

    data = stage(_rows(docs).mapInArrow(arrays, "rep long, hi long, lo long, data binary"), "pair-data")
    if not data.groupBy("rep", "hi", "lo").count().where("count > 1").isEmpty():  # rows with the same doc_id and text
        data, twice = stage(data.dropDuplicates(["rep", "hi", "lo"]), "pair-data"), data
        discard(twice)
    named = pairs.join(of.toDF("a", "hi1", "lo1", "r1"), "a").join(of.toDF("b", "hi2", "lo2", "r2"), "b")
    named = named.join(data.toDF("r1", "hi1", "lo1", "x"), ["r1", "hi1", "lo1"]).join(data.toDF("r2", "hi2", "lo2", "y"), ["r2", "hi2", "lo2"])
    out = stage(named.select("a", "b", "x", "y").mapInArrow(decided, "a long, b long"), "decided")
    discard(data, *([rest] if not bounded else []))
    return out


def maybe_in(df: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """The rows whose ``column`` is in a bitmap, and a few others; a join that follows then moves these alone."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_bitmap(shared.value, b.column(column).to_numpy())))

    return df.mapInArrow(run, df.schema)


def similar_components(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of ``docs(doc_id, text)``."""
    whole = stage(document_sets(docs, common_shingles(docs), share), "sets")
    own = whole.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("first_doc"), F.min("rep").alias("rep"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"), F.first("rare").alias("rare"))
    keyed = stage(own.withColumn("cid", F.monotonically_increasing_id()), "keyed-classes")  # written, so that a class keeps its number
    sets = stage(whole.select("doc_id", "n", "hi", "lo"), "sets")
    discard(whole)

    tiles = stage(neighbours(keyed, share), "tiles")
    classes = stage(keyed.drop("keys", "rare"), "classes")
    discard(keyed)

    first = stage(_nearest(tiles, share), "pairs")
    links = linked(first, docs, classes, share, bounded=False)
    roots = components(links)
    discard(first, links)
    for few in (FEW, FEW, None):
        met = stage(meetings(tiles, roots, classes, share, few), "met")
        pairs = stage(met.where("a is not null").select("a", "b").distinct(), "pairs")
        if not pairs.isEmpty():
            links = linked(pairs, docs, classes, share, bounded=True)
            roots, old = _joined(roots, links), roots
            discard(links, old)
        still = met.where("a is null").select("key").distinct()
        if few is None or still.isEmpty():
            discard(met, pairs, tiles)
            break
        tiles, old = stage(maybe_in(tiles, "key", bitmap(still, "key")).join(still, "key", "left_semi"), "tiles"), tiles
        discard(met, pairs, old)

    firsts = classes.select("hi", "lo", "n", "cid", "first_doc").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    smallest = firsts.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_class = firsts.join(smallest, "root").select("hi", "lo", "n", "component_id")
    out = sets.select("doc_id", "n", "hi", "lo").join(of_class, ["hi", "lo", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after more links: these join whole components, so the graph of their roots is what is left to solve."""
    of = lambda side: F.coalesce(f"{side}.root", F.col(side + "_id"))
    ends = links.select(F.col("a").alias("x_id"), F.col("b").alias("y_id")).join(roots.alias("x"), F.col("x_id") == F.col("x.id"), "left").join(roots.alias("y"), F.col("y_id") == F.col("y.id"), "left")
    joined = components(ends.select(of("x").alias("a"), of("y").alias("b")))
    nodes = roots.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("root").alias("root"))
    out = stage(nodes.join(joined.toDF("root", "to"), "root", "left").select("id", F.coalesce("to", "root").alias("root")), "roots")
    discard(joined)
    return out


def keep_one(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest doc_id; all columns kept.

    The ids that go are written first, so that the planner knows their size: few are broadcast, many are joined. Rows
    that share a doc_id stay or go together, and rows without one stay, as no id tells them apart.
    """
    name = unused(docs, "gone")
    gone = stage(similar_components(docs, share).where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "near-duplicates")
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def neighbours(keyed: DataFrame, share: int) -> DataFrame:
    """(key, cid, n, pos, before, head): a row for each set in each tile where it may have a partner, with the next smaller
    set and the smallest of its size band. Both only steer the search, so common tiles, of which no row is left out, are
    dealt over parts that know nothing of each other.

    Nearly all shingles are met once, so this shuffle is the largest of all: it moves the plain columns alone, size and
    place in one of them, and the windows build what else they need behind it.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / share)))
    salt = F.when(F.col("pos") >= F.col("rare"), F.pmod(F.xxhash64("cid"), F.lit(SALTS)) + 1).otherwise(0)
    rows = keyed.select("cid", "n", "rare", F.posexplode("keys").alias("pos", "key")).select(salt.alias("salt"), "cid", "key", F.expr("shiftleft(cast(n as long), 32) + pos").alias("place"))
    rows = rows.repartition("key", "salt").select("key", "salt", "cid", F.expr("cast(shiftright(place, 32) as int)").alias("n"), F.expr("cast(place & 4294967295L as int)").alias("pos"))
    rows = rows.withColumn("reach", F.expr(f"100L * n - (100L + {share}) * pos"))  # share times the largest size that it can meet here
    tile = Window.partitionBy("key", "salt").orderBy("n", "cid")
    smaller = {"c1": F.lag("cid").over(tile), "n1": F.lag("n").over(tile), "p1": F.lag("pos").over(tile), "least": F.first("n").over(tile), "most": F.max("reach").over(tile.rowsBetween(Window.unboundedPreceding, -1))}
    larger = {"n2": F.lead("n").over(tile), "r2": F.lead("reach").over(tile), "n3": F.lead("n", 2).over(tile)}
    partner = f"most >= {share}L * n and reach >= {share}L * least or reach >= {share}L * n2 and (r2 >= {share}L * n or reach >= {share}L * n3)"
    rows = rows.withColumns(smaller | larger).where(f"salt > 0 or {partner}")
    rows = rows.withColumn("before", F.when(F.col("c1").isNotNull(), F.struct(F.col("c1").alias("cid"), F.col("n1").alias("n"), F.col("p1").alias("pos"))))
    rows = rows.withColumn("head", F.first(F.struct("cid", "n", "pos")).over(Window.partitionBy("key", "salt", band).orderBy("n", "cid").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("key", "cid", "n", "pos", "before", F.when(F.col("head.cid") != F.col("cid"), F.col("head")).alias("head"))


def _nearest(tiles: DataFrame, share: int) -> DataFrame:
    """(a, b): each set b with the head, and with the neighbour, with which it shares most tiles; at most two pairs a set."""
    met = tiles.select(F.col("cid").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.posexplode(F.array("before", "head")).alias("kind", "p")).where("p is not null")
    need = F.expr(f"ceil({share}L * (p.n + m) / (100 + {share}))")  # sizes within the band, and enough places left after the shingle
    met = met.where(F.expr(f"100L * p.n >= {share}L * m") & (F.least(F.expr("p.n - p.pos"), F.expr("m - pos2")) >= need))
    counted = met.groupBy("kind", "b", F.col("p.cid").alias("a")).count()
    return counted.groupBy("kind", "b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b").distinct()


def meetings(tiles: DataFrame, roots: DataFrame, classes: DataFrame, share: int, few: int | None) -> DataFrame:
    """(a, b, key): pairs of different components that meet in a tile and that their bitmaps leave; and, without a pair,
    the tiles in which a set has more than ``few`` of them, of which the nearest is given.

    Tiles of one component drop out first. Those of more than CELL sets are cut into cells, each a pair of parts, and a
    cell's sets meet in order of size, those of the size band alone.
    """
    rows = tiles.select("key", "cid", "n", "pos").join(roots.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    mixed = rows.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count(F.lit(1)).alias("size")).where("r1 <> r2").select("key", F.ceil(F.col("size") / CELL).alias("parts"))
    rows = rows.join(mixed, "key").withColumn("h", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("o", F.explode(F.expr("sequence(0L, parts - 1)")))
    rows = rows.withColumn("one", F.least("h", "o")).withColumn("two", F.greatest("h", "o")).join(classes.select("cid", "sketch"), "cid")
    cell = ["key", "one", "two"]
    rows = rows.repartition(*cell).sortWithinPartitions(*cell, "n", "cid").select(*cell, "h", "cid", "n", "pos", "root", "sketch")

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # sets of the last cell that may still fit
        for b in batches:
            old, every = 0, b
            if held is not None and held.num_rows and b.num_rows:
                old, every = held.num_rows, pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            if not b.num_rows:
                continue
            key, one, two, h, cid, n, pos, root = (every.column(c).to_numpy().astype(np.int64) for c in (*cell, "h", "cid", "n", "pos", "root"))
            starts = np.concatenate([[0], np.flatnonzero((np.diff(key) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1])
            start = np.repeat(starts, np.diff(starts, append=len(key)))
            bits, count, pairs, far = Bitmaps(every.column("sketch")), np.zeros(len(key), np.int64), [], np.arange(old, len(key))
            d, kept = 1, 0
            while len(far):  # every set with the one d places before it
                far = far[far - d >= start[far]]
                far = far[100 * n[far - d] >= share * n[far]]
                i, j = far - d, far
                need = -(-share * (n[i] + n[j]) // (100 + share))
                fit = np.flatnonzero((root[i] != root[j]) & ((h[i] != h[j]) | (one[j] == two[j])) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need))
                if len(fit):
                    i, j, need = i[fit], j[fit], need[fit]
                    fit = (n[i] + n[j] - bits.least_difference(i, j)) // 2 >= need
                    i, j = i[fit], j[fit]
                    count[j] += 1
                    pairs.append(np.stack([i, j, count[j]], axis=1))
                    kept += len(i)
                    if few is not None:
                        far = far[count[far] <= few]
                if few is None and kept > 1 << 20:
                    yield batch(cid, np.concatenate(pairs), np.empty(0, np.int64))
                    pairs, kept = [], 0
                d += 1
            found = np.concatenate([*pairs, np.empty((0, 3), np.int64)])
            late = count > few if few is not None else np.zeros(len(key), bool)
            yield batch(cid, found[~late[found[:, 1]] | (found[:, 2] == 1)], np.unique(key[late]))
            low = int(start[-1])
            held = every.slice(low + int(np.searchsorted(100 * n[low:], share * n[-1])))

    def batch(cid: np.ndarray, found: np.ndarray, still: np.ndarray) -> pa.RecordBatch:
        both = np.unique(np.sort(cid[found[:, :2]], axis=1), axis=0)
        ends = [pa.array(np.concatenate([both[:, k], np.zeros(len(still), np.int64)]), mask=np.arange(len(both) + len(still)) >= len(both)) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*ends, pa.array(np.concatenate([np.zeros(len(both), np.int64), still]))], names=["a", "b", "key"])

    return rows.mapInArrow(run, "a long, b long, key long")
