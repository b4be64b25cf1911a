"""Vectors stored in cells, searched and joined with themselves exactly: what a cell's centre and reach exclude isn't read.

* ``store`` deals vectors to the nearest of at most CENTRES directions, chosen far apart from a sample of bounded size, and packs those
  of one person and direction into rows of at most ROW: their unit vectors side by side, their own mean direction, and how
  far (as an angle) the farthest of them is from it. The sample decides how tight cells are, never what is found.
* ``search`` bounds the cosine of a question to all of a cell by the angle between them less the cell's reach. A cell that
  can reach neither the floor nor the question's k-th best so far is passed by; the others are matrix products.
* ``alike`` pairs the vectors of a person. Cells meet by their centres first, packed HEADS to a row, and only pairs of cells
  whose reaches let two vectors come within the floor, and whose dates let one precede the other, are read.

Cosines are rounded to four places, as they are compared. Up to BLOCK questions are broadcast, of nearest ``k`` as many as
want ANSWERS in all; more are packed by person and meet the cells by a join, so nothing that grows goes through the driver.
A pack that wants its nearest meets all cells of its person one after the other, and gives on no more than these. Answers leave a task in batches of bounded
size; how many cells it is given at once is up to ``spark.sql.execution.arrow.maxBytesPerBatch``.

Nulls: a row without a person or id is not stored; a null vector, a zero vector and one of another length than most is
stored with cosine 0 to everything. Equal vectors are one cell, cut into rows. Empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..sources.sinks import new_folder

#: Vectors wanted in a cell; directions at most, and vectors sampled for each; vectors in a row; centres in a row where cells meet.
CELL, CENTRES, SAMPLE, ROW, HEADS = 256, 1024, 8, 1024, 512
#: Questions that are broadcast: at 1024 dimensions, 64 MB. Those packed in a row beyond.
BLOCK, PACK = 8192, 512
#: Questions that meet a row of vectors at a time; answers that a task holds before it gives them on, beside those of one such product.
STEP, OUT = 256, 1 << 16
#: Answers that broadcast questions, or those of a pack, may want in all.
ANSWERS = 1 << 18
#: How far a rounded cosine may lie from the real one, and the angle arithmetic from the truth.
SLACK = 1e-4
EPOCH = date(1970, 1, 1).toordinal()
LONG_AGO, FAR_OFF = 0, 1 << 40
STORED = "person long, row long, centre array<double>, reach double, since long, until long, ids array<long>, items array<long>, ordinals array<long>, days array<long>, vectors binary"
PAIRS = "q_id long, person long, chunk_id long, item long, ordinal long, cos double"


def unit_rows(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """The vectors of a list column as rows of length one; zero for a null, a zero vector, or one that has not ``dim``
    numbers (without ``dim``, as many as the first has), or a null among them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().fill_null(0).to_numpy()
    dim = dim if dim is not None else int(sizes[np.flatnonzero(sizes)[0]]) if sizes.any() else 0
    out = np.zeros((len(column), dim))
    fits = np.flatnonzero((sizes == dim) & (dim > 0))
    if len(fits):
        out[fits] = column.take(pa.array(fits)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def rounded(cos: np.ndarray, places: float = 1e4) -> np.ndarray:
    return np.floor(cos * places + 0.5) / places


def angles(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1.0, 1.0))


def nearest_cosine(angle: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """What the cosine to anything within ``reach`` of a direction ``angle`` away is at most."""
    return np.cos(np.maximum(angle - reach, 0.0)) + SLACK


def _days(b: pa.RecordBatch, name: str, absent: int) -> np.ndarray:
    return b.column(name).cast(pa.int64()).fill_null(absent).to_numpy()


def _row(b: pa.RecordBatch, number: int, dim: int | None) -> pa.RecordBatch:
    u = unit_rows(b.column("vector"), dim)
    centre = u.sum(axis=0)
    size = np.sqrt((centre * centre).sum())
    centre = centre / size if size > 0 else centre
    reach = float(angles(u @ centre).max()) if size > 0 and (u * u).sum(axis=1).min() > 0.5 else np.pi
    days = _days(b, "day", FAR_OFF)
    known = days[days != FAR_OFF]
    head = [b.column("person")[:1].cast(pa.int64()), pa.array([number]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([reach]), pa.array([int(known.min()) if len(known) else FAR_OFF]), pa.array([int(known.max()) if len(known) else -FAR_OFF])]
    lists = [pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), x) for x in (*(b.column(c).cast(pa.int64()).combine_chunks() if isinstance(b.column(c), pa.ChunkedArray) else b.column(c).cast(pa.int64()) for c in ("id", "item", "ordinal")), pa.array(days))]
    return pa.RecordBatch.from_arrays([*head, *lists, pa.array([u.tobytes()], pa.binary())], names=[x.split()[0] for x in STORED.split(", ")])


def _packed(rows: DataFrame, cell: list[str], most: int, dim: int) -> DataFrame:
    """STORED rows of ``rows(person, id, item, ordinal, day, vector)`` that agree in ``cell``, at most ``most`` vectors each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: pa.RecordBatch | None = None
        for b in batches:
            every = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            cuts = _cuts(every)
            for i, j in zip(cuts, cuts[1:-1]):
                yield _row(every.slice(i, j - i), number, dim)
                number += 1
            held = every.slice(cuts[-2], every.num_rows - cuts[-2])
        if held is not None and held.num_rows:
            yield _row(held, number, dim)

    def _cuts(b: pa.RecordBatch) -> list[int]:
        """Where cells begin, and after every ``most`` rows of one; at last the end."""
        change = np.zeros(b.num_rows, bool)
        change[:1] = True
        for c in cell:
            x = b.column(c).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        first = np.flatnonzero(change)
        place = np.arange(b.num_rows) - np.repeat(first, np.diff(first, append=b.num_rows))
        return [*np.flatnonzero(place % most == 0).tolist(), b.num_rows]

    return rows.repartition(*cell).sortWithinPartitions(*cell, "id").mapInArrow(run, STORED)


def spread(u: np.ndarray, wanted: int) -> np.ndarray:
    """At most ``wanted`` of the directions ``u``, each the farthest from those before it."""
    nearest, taken = np.full(len(u), -2.0), []
    while len(taken) < min(wanted, len(u)) and (not taken or nearest.min() < 1 - SLACK):
        taken.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, u @ u[taken[-1]])
    return u[taken]


def _written(rows: DataFrame, name: str) -> DataFrame:
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _given(chunks: DataFrame) -> DataFrame:
    day = F.unix_date(F.col("published_at").cast("date")) if "published_at" in chunks.columns else F.lit(None)
    own = [F.col(a).cast("long").alias(b) for a, b in (("person", "person"), ("chunk_id", "id"), ("item", "item"), ("ordinal", "ordinal"))]
    return chunks.select(*own, day.cast("long").alias("day"), F.col("embedding").cast("array<double>").alias("vector")).where("person is not null and id is not null")


def store(chunks: DataFrame) -> DataFrame:
    """STORED of ``chunks(chunk_id, person, item, ordinal, embedding)``, with ``published_at`` where they have it; written
    to the shared folder. ``row`` numbers the rows."""
    rows = _given(chunks)
    shape = rows.where("vector is not null").agg(F.count(F.lit(1)), F.mode(F.size("vector"))).first()
    n, dim = shape[0], shape[1] or 0
    wanted = max(1, min(CENTRES, -(-n // CELL)))
    sample = rows.where(F.size("vector") == dim).orderBy(F.xxhash64("id"), "id").limit(SAMPLE * wanted).select("vector").toArrow()
    centres = rows.sparkSession.sparkContext.broadcast(spread(unit_rows(sample.column("vector"), dim), wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = unit_rows(b.column("vector"), dim)
            cell = np.full(len(u), -1)  # of vectors without a direction
            some = np.flatnonzero((u * u).sum(axis=1) > 0.5)
            if len(centres.value) and len(some):
                cell[some] = np.argmax(u[some] @ centres.value.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=[*b.schema.names, "cell"])

    dealt = rows.mapInArrow(run, "person long, id long, item long, ordinal long, day long, vector array<double>, cell long")
    return _written(_packed(dealt, ["person", "cell"], ROW, dim), "cells")


def _loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        people = b.column("person").to_numpy()
        order = np.argsort(people, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(people[order])) + 1) if len(order) else []:
            for at in range(0, len(own), ROW):
                yield _row(b.take(pa.array(own[at : at + ROW])), 0, None)


def loose(chunks: DataFrame) -> DataFrame:
    """STORED of ``chunks`` as ``store``, but of each person's in a batch as they come: nothing is counted, shuffled or written."""
    return _given(chunks).mapInArrow(_loose, STORED)


class Cell:
    """A STORED row."""

    def __init__(self, b: pa.RecordBatch, k: int, prefix: str = ""):
        get = lambda c: b.column(prefix + c)
        ints = lambda c: get(c)[k].values.to_numpy()
        self.person, self.reach = get("person")[k].as_py(), get("reach")[k].as_py()
        self.ids, self.items, self.ordinals, self.days = ints("ids"), ints("items"), ints("ordinals"), ints("days")
        self.centre = get("centre")[k].values.to_numpy()
        self.vectors = np.frombuffer(get("vectors")[k].as_buffer(), np.float64).reshape(len(self.ids), -1)


class Asked:
    """Questions of any people, with the cosine that their k-th best has at least."""

    def __init__(self, ids: np.ndarray, people: np.ndarray, since: np.ndarray, until: np.ndarray, vectors: np.ndarray, floor: float | None):
        self.ids, self.people, self.since, self.until, self.vectors = ids, people, since, until, vectors
        self.least = np.full(len(ids), -np.inf if floor is None else floor)

    def reached(self, cells: list[Cell]) -> Iterator[tuple[Cell, np.ndarray]]:
        """Cells, the most promising first, with the questions that they may answer at that time."""
        for p in {c.person for c in cells}:
            mine, own = np.flatnonzero(self.people == p), [c for c in cells if c.person == p]
            if not len(mine):
                continue
            far = angles(self.vectors[mine] @ np.stack([c.centre for c in own]).T)
            most = nearest_cosine(far, np.array([c.reach for c in own]))
            for k in np.argsort(-most.max(axis=0), kind="stable").tolist():
                yield own[k], mine[most[:, k] >= self.least[mine]]

    def answer(self, cell: Cell, which: np.ndarray, k: int | None, floor: float | None, own: bool) -> list[np.ndarray]:
        """(question, place in the cell, cosine) of what is near enough, at most k a question; raises what the k-th needs."""
        cos = rounded(self.vectors[which] @ cell.vectors.T)
        undated = cell.days == FAR_OFF
        open_ = (self.since[which] == LONG_AGO) & (self.until[which] == FAR_OFF)
        days = cell.days + EPOCH
        fits = np.where(undated[None, :], open_[:, None], (days[None, :] >= self.since[which][:, None]) & (days[None, :] <= self.until[which][:, None]))
        if not own:
            fits &= cell.ids[None, :] != self.ids[which][:, None]
        if floor is not None:
            fits &= cos >= floor
        fits &= cos >= self.least[which][:, None]
        if k is None or fits.sum(axis=1).max(initial=0) <= k:
            q, at = np.nonzero(fits)
        else:
            parts = []
            for i in range(len(which)):
                at = np.flatnonzero(fits[i])
                parts.append((np.full(min(k, len(at)), i), at[np.lexsort((cell.ids[at], cell.items[at], -cos[i, at]))[:k]]))
            q, at = (np.concatenate(x) for x in zip(*parts))
        if k is not None and len(q):
            some, first, count = np.unique(q, return_index=True, return_counts=True)
            full, least = count >= k, np.minimum.reduceat(cos[q, at], first) - SLACK
            self.least[which[some[full]]] = np.maximum(self.least[which[some[full]]], least[full])
        return [which[q], at, cos[q, at]]


class Nearest:
    """The nearest ``k`` of each question of a pack among the cells met so far; what falls behind them is dropped as it grows."""

    def __init__(self, asked: Callable[[int], Asked], k: int, floor: float | None, own: bool):
        self.asked, self.k, self.floor, self.own = asked, k, floor, own
        self.known: dict[int, Asked] = {}  # by width
        self.held: list[list[np.ndarray]] = []
        self.n, self.person, self.least = 0, None, None

    def meet(self, cell: Cell) -> None:
        dim = cell.vectors.shape[1]
        if dim not in self.known:
            self.known[dim] = self.asked(dim)
            self.least = self.known[dim].least if self.least is None else self.least
            self.known[dim].least = self.least
        self.person = cell.person
        for _, which in self.known[dim].reached([cell]):
            for low in range(0, len(which), STEP):
                q, at, cos = self.known[dim].answer(cell, which[low : low + STEP], None, self.floor, self.own)
                if len(q):
                    self.held.append([q, cos, cell.items[at], cell.ids[at], cell.ordinals[at]])
                    self.n += len(q)
                if self.n >= 2 * ANSWERS:
                    self.prune(False)
                if self.n >= 2 * ANSWERS:  # ties
                    self.prune(True)

    def prune(self, exact: bool) -> None:
        """Drops what lies behind the k-th; of ties with it all stay, or, if ``exact``, those that come first."""
        q, cos, item, ids, ordinal = (np.concatenate(c) for c in zip(*self.held))
        near = np.rint(-cos / SLACK).astype(np.int64)
        order = np.lexsort((ids, item, near, q)) if exact else np.argsort(q * (1 << 20) + near, kind="stable")
        q, cos = q[order], cos[order]
        some, first, count = np.unique(q, return_index=True, return_counts=True)
        full = count >= self.k
        last = np.full(len(self.least), -np.inf)
        last[some[full]] = cos[first[full] + self.k - 1]
        self.least[:] = np.maximum(self.least, last - SLACK)
        keep = np.arange(len(q)) - np.repeat(first, count) < self.k if exact else cos >= last[q]
        self.held = [[q[keep], cos[keep], *(x[order][keep] for x in (item, ids, ordinal))]]
        self.n = int(keep.sum())

    def answers(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self.prune(True)
            q, cos, item, ids, ordinal = self.held[0]
            names = next(iter(self.known.values())).ids
            for low in range(0, self.n, OUT):
                part = slice(low, low + OUT)
                yield _pairs([[names[q[part]], np.full(len(q[part]), self.person), ids[part], item[part], ordinal[part], cos[part]]])


def _answers(cells: list[Cell], asked: Asked, k: int | None, floor: float | None, own: bool, reads: bool) -> Iterator[pa.RecordBatch]:
    """PAIRS, or what was read, in batches of about OUT rows: STEP questions meet a row of vectors at a time."""
    every, read = np.zeros(len(asked.ids), np.int64), np.zeros(len(asked.ids), np.int64)
    held, n = [], 0
    for c in cells if reads else []:
        every[asked.people == c.person] += len(c.ids)
    for cell, which in asked.reached(cells):
        read[which] += len(cell.ids)
        for low in range(0, len(which), STEP):
            q, at, cos = asked.answer(cell, which[low : low + STEP], k, floor, own)
            if len(q) and not reads:
                held.append([asked.ids[q], np.full(len(q), cell.person), cell.ids[at], cell.items[at], cell.ordinals[at], cos])
                n += len(q)
            if n >= OUT:
                yield _pairs(held)
                held, n = [], 0
    if reads:
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids), pa.array(every), pa.array(read)], names=["q_id", "n", "n_read"])
    elif held:
        yield _pairs(held)


def _pairs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=[x.split()[0] for x in PAIRS.split(", ")])


def _run(cells: DataFrame, questions: DataFrame, k: int | None, floor: float | None, own: bool, reads: bool, block: int = BLOCK, raw: bool = False) -> DataFrame:
    bounds = [F.unix_date(F.col(c).cast("date")).cast("long").alias(c) if c in questions.columns else F.lit(None).cast("long").alias(c) for c in ("since", "until")]
    q = questions.select(F.col("q_id").cast("long").alias("q_id"), F.col("person").cast("long").alias("person"), *bounds, F.col("q_vec").cast("array<double>").alias("vector")).where("person is not null and q_id is not null")
    schema = "q_id long, n long, n_read long" if reads else PAIRS
    pack = PACK
    if k is not None and not reads:
        block, pack = min(block, ANSWERS // max(k, 1)), max(1, min(PACK, ANSWERS // max(k, 1)))
    few = q.limit(block + 1).toArrow()  # bounded: what doesn't fit is joined

    def asked(t: pa.Table, dim: int) -> Asked:
        since, until = (np.where(x == FAR_OFF, far, x + EPOCH) for x, far in ((_days(t, "since", FAR_OFF), LONG_AGO), (_days(t, "until", FAR_OFF), FAR_OFF)))
        return Asked(t.column("q_id").to_numpy(), t.column("person").to_numpy(), since, until, unit_rows(t.column("vector"), dim), floor)

    if few.num_rows <= block:
        shared = cells.sparkSession.sparkContext.broadcast(few)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict[int, Asked] = {}  # by width; keeps the k-th best from batch to batch
            for b in _loose(batches) if raw else batches:  # in the same worker, as a second one a task would take its own memory
                own_cells = [Cell(b, i) for i in range(b.num_rows)]
                for dim in {c.vectors.shape[1] for c in own_cells}:
                    known[dim] = known.get(dim) or asked(shared.value, dim)
                    yield from _answers([c for c in own_cells if c.vectors.shape[1] == dim], known[dim], k, floor, own, reads)

        return (_given(cells) if raw else cells).mapInArrow(near, schema)

    many = q.withColumn("pack", F.pmod(F.xxhash64("q_id"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("person")) / pack)))
    packs = many.groupBy("person", "pack").agg(F.collect_list(F.struct("q_id", "person", "since", "until", "vector")).alias("asked"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell, t = Cell(b, i), pa.Table.from_struct_array(b.column("asked")[i].values).combine_chunks()
                yield from _answers([cell], asked(t, cell.vectors.shape[1]), k, floor, own, reads)

    rows = loose(cells) if raw else cells
    if k is None or reads:
        return rows.join(packs.select("person", "asked"), "person").mapInArrow(joined, schema)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: Nearest | None = None
        for b in batches:
            for i, head in enumerate(b.column("head").to_pylist()):
                if head:
                    if state:
                        yield from state.answers()
                    t = pa.Table.from_struct_array(b.column("asked")[i].values).combine_chunks()
                    state = Nearest(lambda dim, t=t: asked(t, dim), k, floor, own)
                elif state:
                    state.meet(Cell(b, i))
        if state:
            yield from state.answers()

    heads = packs.select("person", "pack", "asked", F.lit(True).alias("head"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema if f.name != "person"])
    met = rows.join(packs.select("person", "pack"), "person").withColumn("head", F.lit(False)).withColumn("asked", F.lit(None).cast(packs.schema["asked"].dataType))
    return heads.unionByName(met).repartition("person", "pack").sortWithinPartitions("person", "pack", F.desc("head")).mapInArrow(nearest, schema)


def search(cells: DataFrame, questions: DataFrame, k: int | None = None, floor: float | None = None, own: bool = False, block: int = BLOCK, raw: bool = False) -> DataFrame:
    """PAIRS of each question (q_id, person, q_vec, and since, until where given, both inclusive) and the stored vectors of
    its person: those with a cosine of at least ``floor``, the nearest ``k`` of them with their rank ``r``.

    ``raw``: ``cells`` are chunks as ``loose`` takes them. Undated vectors answer questions without bounds alone. Unless ``own`` is set, a vector does not answer the question
    of its own id.
    """
    out = _run(cells, questions, k, floor, own, False, block, raw)
    if k is None:
        return out
    return out.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("cos"), "item", "chunk_id"))).where(F.col("r") <= k)


def reads(cells: DataFrame, questions: DataFrame, k: int | None = None, floor: float | None = None, block: int = BLOCK) -> DataFrame:
    """(q_id, n, n_read): how many vectors of its person each question has, and of how many its cosine was computed."""
    out = _run(cells, questions, k, floor, True, True, block)
    return out.groupBy("q_id").agg(F.sum("n").alias("n"), F.sum("n_read").alias("n_read"))


MET = "person long, row_a long, row_b long, read boolean"
BEST = "person long, pa long, pb long, cos double, claim_a long, claim_b long, since_a long, since_b long"


def cell_pairs(cells: DataFrame, floor: float) -> DataFrame:
    """MET: pairs of rows of a person, each with itself too, and whether they may hold vectors within ``floor``, one dated
    before the other. Only centres meet here."""
    heads = cells.select("person", F.col("row").alias("id"), F.struct("row", "centre", "reach", "since", "until").alias("head"))
    packs = heads.withColumn("pack", F.pmod(F.xxhash64("id"), F.ceil(F.count(F.lit(1)).over(Window.partitionBy("person")) / HEADS))).groupBy("person", "pack").agg(F.collect_list("head").alias("heads"))
    both = packs.alias("x").join(packs.alias("y"), F.expr("x.person = y.person and x.pack <= y.pack")).select("x.person", F.expr("x.pack = y.pack").alias("same"), F.col("x.heads").alias("xs"), F.col("y.heads").alias("ys"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sides = [pa.Table.from_struct_array(b.column(c)[i].values) for c in ("xs", "ys")]
                rows, reach, since, until = ([s.column(c).to_numpy() for s in sides] for c in ("row", "reach", "since", "until"))
                x, y = (np.array(s.column("centre").to_pylist()) for s in sides)
                most = nearest_cosine(angles(x @ y.T), reach[0][:, None] + reach[1][None, :])
                apart = (since[0][:, None] < until[1][None, :]) | (since[1][None, :] < until[0][:, None])
                met = rows[0][:, None] <= rows[1][None, :] if b.column("same")[i].as_py() else np.ones(most.shape, bool)
                m, n = np.nonzero(met)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), b.column("person")[i].as_py(), np.int64)), pa.array(rows[0][m]), pa.array(rows[1][n]), pa.array((most >= floor)[m, n] & apart[m, n])], names=[c.split()[0] for c in MET.split(", ")])

    return both.mapInArrow(run, MET)


def _between(a: Cell, b: Cell, floor: float) -> pa.RecordBatch:
    """BEST of two rows: for each pair of items its nearest pair of vectors, the earlier item first."""
    cos = rounded(a.vectors @ b.vectors.T)
    i, j = np.nonzero((cos >= floor) & (a.items[:, None] != b.items[None, :]) & (a.days[:, None] != b.days[None, :]) & (a.days[:, None] != FAR_OFF) & (b.days[None, :] != FAR_OFF))
    early = a.days[i] < b.days[j]
    cols = {k: np.where(early, x, y) for k, (x, y) in {"pa": (a.items[i], b.items[j]), "pb": (b.items[j], a.items[i]), "ca": (a.ids[i], b.ids[j]), "cb": (b.ids[j], a.ids[i]), "da": (a.days[i], b.days[j]), "db": (b.days[j], a.days[i])}.items()}
    c = cos[i, j]
    order = np.lexsort((cols["cb"], cols["ca"], -c, cols["pb"], cols["pa"]))
    pa_, pb_ = cols["pa"][order], cols["pb"][order]
    first = order[np.flatnonzero(np.append(True, (pa_[1:] != pa_[:-1]) | (pb_[1:] != pb_[:-1])))[: len(order)]] if len(order) else order
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), a.person, np.int64)), *(pa.array(x[first]) for x in (cols["pa"], cols["pb"], c, cols["ca"], cols["cb"], cols["da"], cols["db"]))], names=[x.split()[0] for x in BEST.split(", ")])


def alike(claims: DataFrame, floor: float = 0.65, most: int = 120) -> DataFrame:
    """(person, pa, pb, cos, claim_a, claim_b, gap_days, r, bounded_out): pairs of positions of a person that say nearly the same.

    ``claims(claim_id, person, position, since, embedding)``: ``since`` is that of the position. A pair stands for its
    nearest claims, goes from the earlier position to the later, and is left out where either is undated or both are of
    one day. The nearest ``most`` of a person are kept; ``bounded_out`` counts the others.
    """
    rows = claims.select(F.col("claim_id").alias("chunk_id"), "person", F.col("position").alias("item"), F.lit(0).alias("ordinal"), F.col("since").alias("published_at"), "embedding").where("since is not null")
    cells = store(rows)
    met = cell_pairs(cells, floor).where("read").select("person", "row_a", "row_b")
    side = lambda s: cells.select(*[F.col(c).alias(f"{s}_{c}") for c in cells.columns])
    both = met.join(side("a"), F.col("row_a") == F.col("a_row")).join(side("b"), F.col("row_b") == F.col("b_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                yield _between(Cell(b, k, "a_"), Cell(b, k, "b_"), floor)

    best = both.drop("row_a", "row_b", "person").mapInArrow(run, BEST).groupBy("person", "pa", "pb").agg(F.min_by(F.struct("cos", "claim_a", "claim_b", "since_a", "since_b"), F.struct(-F.col("cos"), "claim_a", "claim_b")).alias("x"))
    best = _written(best.select("person", "pa", "pb", "x.*"), "alike")
    total = best.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    ranked = best.withColumn("r", F.row_number().over(Window.partitionBy("person").orderBy(F.desc("cos"), "pa", "pb"))).where(F.col("r") <= most)
    return ranked.join(total, "person").select("person", "pa", "pb", "cos", "claim_a", "claim_b", (F.col("since_b") - F.col("since_a")).alias("gap_days"), "r", F.greatest(F.col("n") - most, F.lit(0)).alias("bounded_out"))


def revisions(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(person, pa, pb, relation, gap_days, rationale) of ``alike`` pairs by the judgements on them.

    ``verdicts(person, ref, relation, rationale, arrived)``: ``ref`` is p and the rank of a pair among its person's. The
    first judgement that arrived on a pair counts; ``none`` dismisses it; a ref that was never sent is dropped.
    """
    first = verdicts.groupBy("person", "ref").agg(F.min_by(F.struct("relation", "rationale"), "arrived").alias("v"))
    named = candidates.withColumn("ref", F.concat(F.lit("p"), F.col("r").cast("string")))
    return named.join(first, ["person", "ref"]).where("v.relation <> 'none'").select("person", "pa", "pb", "v.relation", "gap_days", "v.rationale")


def judged(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(person, candidates, judged, dismissed, dropped_unknown, bounded_out): what became of a person's pairs and of the judgements on them."""
    first = verdicts.groupBy("person", "ref").agg(F.min_by("relation", "arrived").alias("relation"), F.count(F.lit(1)).alias("n"))
    named = candidates.select("person", F.concat(F.lit("p"), F.col("r").cast("string")).alias("ref"), "bounded_out", F.lit(1).alias("sent"))
    both = named.join(first, ["person", "ref"], "full").groupBy("person")
    return both.agg(F.count("sent").alias("candidates"), F.count_if(F.col("sent").isNotNull() & (F.col("relation") != "none")).alias("judged"), F.count_if(F.col("sent").isNotNull() & (F.col("relation") == "none")).alias("dismissed"),
                    F.coalesce(F.sum(F.when(F.col("sent").isNull(), F.col("n"))), F.lit(0)).alias("dropped_unknown"), F.coalesce(F.max("bounded_out"), F.lit(0)).alias("bounded_out"))
