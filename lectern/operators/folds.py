"""Folds along an order: rows numbered within groups without a window of one task a group, and greedy packing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.sinks import new_folder


def _unused(rows: DataFrame, *names: str) -> list[str]:
    """Names like these that no column has, whatever its case."""
    taken = {c.lower() for c in rows.columns}
    return [next(x for x in (f"{'_' * k}{n}" for k in range(2, 99)) if x.lower() not in taken) for n in names]


def numbered(rows: DataFrame, key: str, order: list, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, within ``key`` by ``order`` (columns, which should end in a unique one).

    As ``row_number`` over the key, but a key's rows are dealt over all tasks by range: each part numbers its own rows and
    adds the counts of the parts before it, of which there is a row for each part and key. The sorted rows are written
    once, so that a lost task can't sort them otherwise. Rows of a null key are numbered as those of one key. Columns may
    have any names.
    """
    spark = rows.sparkSession
    path = new_folder(spark, "numbered")
    part, at, before = _unused(rows, "part", "at", "before")
    q = lambda c: F.col(f"`{c}`")
    ordered = rows.repartitionByRange(q(key), *order).sortWithinPartitions(q(key), *order)
    local = Window.partitionBy(part, q(key)).orderBy(*order)
    ordered.withColumn(part, F.spark_partition_id()).withColumn(at, F.row_number().over(local)).write.parquet(path)
    stored = spark.read.parquet(path)
    counts = stored.groupBy(part, q(key)).agg(F.count(F.lit(1)).alias(at))
    sums = counts.select(part, q(key), F.coalesce(F.sum(at).over(Window.partitionBy(q(key)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    both = stored.alias("r").join(sums.alias("b"), F.col(f"r.{part}").eqNullSafe(F.col(f"b.{part}")) & F.col(f"r.`{key}`").eqNullSafe(F.col(f"b.`{key}`")))
    return both.select(*[F.col(f"r.`{c}`") for c in rows.columns], (F.col(at) + F.col(before)).alias(name))


#: Lines of a part, which one task packs.
PART = 1 << 16
HOPS = "k string, part long, entry long, exit long, hops long"


def _next(sizes: np.ndarray, budget: int, gap: int) -> np.ndarray:
    """Of each line the first that no longer fits into a pass which begins with it."""
    before = np.concatenate([[0], np.cumsum(sizes + gap)])
    return np.maximum(np.searchsorted(before[1:], before[:-1] + budget + gap, "right"), np.arange(len(sizes)) + 1)


def _through(k: str, part: int, sizes: np.ndarray, own: int, heads: int, budget: int, gap: int) -> pd.DataFrame:
    """HOPS of a part's first ``heads`` lines: where passes that go on from there leave the part, and how many begin in it."""
    after = _next(sizes, budget, gap)[:own]
    leave, hops = np.empty(own, np.int64), np.ones(own, np.int64)
    inside = after < own
    leave[~inside] = after[~inside] - own
    for i in np.flatnonzero(inside)[::-1].tolist():
        leave[i], hops[i] = leave[after[i]], hops[after[i]] + 1
    n = min(heads, own)
    return pd.DataFrame({"k": k, "part": part, "entry": np.arange(n), "exit": leave[:n], "hops": hops[:n]})


def passes(rows: DataFrame, key: str, order: list, size: str, budget: int, gap: int = 1, name: str = "pass", part: int = PART) -> DataFrame:
    """``rows`` with the number, from 0, of the pass they fall into: lines are taken in order while their sizes, and a gap
    after each, stay within the budget; a line that alone is longer has a pass of its own.

    Where the next pass begins is, for every line, a bisection of the sums before. A key's lines are cut into parts, each
    with as many lines of the next one as a pass can reach; a task finds, for each line at which a pass from the part
    before may enter, where it leaves and how many passes begin in between. These tables are joined with themselves, over
    two parts, four, eight and so on, until the first line's way through all parts is known; then each part numbers its
    own lines. So a key runs over as many tasks as it has parts, in rounds that grow with the logarithm of their number.

    ``gap`` is at least 1. A null size is 0; a null key is one key; ties are in the order that ``order`` gives, which
    should end in a unique column. Columns may have any names. An empty table gives no row.
    """
    if gap < 1:
        raise ValueError("lines without a gap could fill a pass without end")
    heads = budget // gap + 2  # a pass holds fewer lines
    part = max(part, heads)
    place, number, k = _unused(rows, "place", "number", "k")
    placed = numbered(rows, key, order, place).withColumn(k, F.coalesce(F.concat(F.lit("v"), F.col(f"`{key}`").cast("string")), F.lit("n")))
    lines = placed.select(F.col(k).alias("k"), (F.col(place) - 1).alias("at"), F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("size"), F.expr(f"({place} - 1) div {part}").alias("part"))
    last = lines.agg(F.max("part")).first()[0] or 0
    none = F.lit(0).cast("long")
    entries = _kept(lines.where("at = 0").select("k", none.alias("part"), none.alias("entry"), none.alias("begun")))
    if last:
        reach = lines.where(f"part > 0 and at % {part} < {heads}").withColumn("part", F.col("part") - 1)

        def through(own: tuple, block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values("at")
            return _through(own[0], own[1], block["size"].to_numpy(), int((block["at"] // part == own[1]).sum()), heads, budget, gap)

        step, jumps = 1, [_kept(lines.union(reach.select(*lines.columns)).groupBy("k", "part").applyInPandas(through, HOPS))]
        while 2 * step <= last:
            one, two = jumps[-1].alias("x"), jumps[-1].alias("y")
            far = one.join(two, F.expr(f"x.k = y.k and x.part + {step} = y.part and x.exit = y.entry")).select("x.k", "x.part", "x.entry", "y.exit", (F.col("x.hops") + F.col("y.hops")).alias("hops"))
            jumps.append(_kept(far))
            step *= 2
        for jump in reversed(jumps):
            on = entries.alias("e").join(jump.alias("j"), ["k", "part", "entry"]).select("k", (F.col("part") + step).alias("part"), F.col("exit").alias("entry"), (F.col("begun") + F.col("hops")).alias("begun"))
            entries = _kept(entries.union(on))
            step //= 2

    def count(own: tuple, block: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        after, begins = _next(block["size"].to_numpy(), budget, gap), np.zeros(len(block), np.int64)
        i, begun = (int(entry["entry"].iloc[0]), int(entry["begun"].iloc[0])) if len(entry) else (len(block), 0)
        while i < len(block):
            begins[i] = 1
            i = int(after[i])
        return pd.DataFrame({"k": own[0], "at": block["at"], "number": np.cumsum(begins) + begun - 1})

    numbers = lines.groupBy("k", "part").cogroup(entries.groupBy("k", "part")).applyInPandas(count, "k string, at long, number long").select(F.col("k").alias(k), (F.col("at") + 1).alias(place), F.col("number").alias(number))
    return placed.join(numbers, [k, place]).select(*[F.col(f"`{c}`") for c in rows.columns], F.col(number).alias(name))


def _kept(rows: DataFrame) -> DataFrame:
    path = new_folder(rows.sparkSession, "passes")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def unique_slugs(rows: DataFrame, group: str, base: str, order: list, name: str = "slug") -> DataFrame:
    """``rows`` with a slug of its own each: the base, or the first of base-2, base-3 and so on that no row before it in
    the group has, whether by suffix or by its own base.

    What is free depends on all rows before, so a group is named in one task, which holds the group's slugs.
    """
    names = rows.columns
    at = names.index(group), names.index(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, tried = object(), set(), {}
        for b in batches:
            out = []
            for own, slug in zip(b.column(at[0]).to_pylist(), b.column(at[1]).to_pylist()):
                if own != last:
                    last, taken, tried = own, set(), {}
                new, k = slug, tried.get(slug, 1)
                while new in taken:
                    k += 1
                    new = f"{slug}-{k}"
                tried[slug] = k
                taken.add(new)
                out.append(new)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*names, name])

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, StructType([*rows.schema.fields, StructField(name, StringType())]))
