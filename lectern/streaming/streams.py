"""Poll-to-poll semantics on Structured Streaming: the batch forms in ``ledgers`` say what each must give.

A stream is any streaming DataFrame of polls (key, ts, seq, ...). Windows and duplicates use watermarks; cursors, gaps,
fault ledgers, counters and retry budgets are folds over one key's polls in order of time, with a few numbers of state a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.sinks import insert_absent, new_folder


def closed_days(polls: DataFrame, key: str = "key", late: str = "0 seconds") -> DataFrame:
    """(key, day, posts) of each UTC day once the watermark has passed it; append mode. Later rows of a closed day are dropped."""
    day = polls.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), key).agg(F.count(F.lit(1)).alias("posts"))
    return day.select(key, F.date_format("window.start", "yyyy-MM-dd").alias("day"), "posts")


def first_inserts(polls: DataFrame, keys: list[str], within: str | None = None) -> DataFrame:
    """The first row of each key; with ``within``, of those that come less than that after the watermark, which bounds the state."""
    return polls.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys) if within else polls.dropDuplicates(keys)


def store_days(days: DataFrame, path: str, late_path: str, checkpoint: str, keys: list[str], order: list[str]):
    """Starts a stream of assembled days into a table in which a stored day is never rewritten; a row that comes for a
    stored day goes to ``late_path``, where it can be counted."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        fresh = insert_absent(batch, path, keys, order)
        batch.exceptAll(fresh).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(late_path)
        batch.unpersist()

    return days.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


Fold = Callable[[tuple, tuple], tuple[tuple, tuple | None]]


def folded(polls: DataFrame, key: str, columns: list[str], begin: tuple, fold: Fold, state: str, out: str) -> DataFrame:
    """Rows of ``out`` that ``fold(state, row)`` gives for the polls of each key in order of (ts, seq); ``state`` is kept between batches.

    A batch's rows of a key come in slices; they are put in order before the fold, so memory holds one key's rows of one batch.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else begin
        rows, found = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable"), []
        for row in rows[columns].itertuples(index=False, name=None):
            now, one = fold(now, row)
            if one is not None:
                found.append((k[0], *one))
        held.update(tuple(x.item() if hasattr(x, "item") else x for x in now))
        yield pd.DataFrame(found, columns=names)

    return polls.groupBy(key).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)


def cursors(polls: DataFrame, key: str = "key", value: str = "k") -> DataFrame:
    """(key, event_id, cursor_at): the largest value so far; it never goes back."""

    def fold(now, row):
        top = row[1] if now[0] is None else max(now[0], row[1])
        return (top,), (row[0], top)

    return folded(polls, key, ["event_id", value], (None,), fold, "top long", f"{key} long, event_id long, cursor_at long")


def gaps(polls: DataFrame, key: str = "key", value: str = "k") -> DataFrame:
    """(key, event_id, reopened): whether a poll's oldest entry is newer than anything seen before it."""

    def fold(now, row):
        return (row[1] if now[0] is None else max(now[0], row[1]),), (row[0], now[0] is not None and row[1] > now[0])

    return folded(polls, key, ["event_id", value], (None,), fold, "top long", f"{key} long, event_id long, reopened boolean")


def faults(polls: DataFrame, key: str = "key", failed: str = "failed", escalate_s: int = 86_400) -> DataFrame:
    """(key, event_id, first_s, last_s, fails, escalated): a row for each failing poll, the state of its open fault; a pass closes it."""

    def fold(now, row):
        event, at, bad = row
        if not bad:
            return (0, 0), None
        first, n = (now[0], now[1] + 1) if now[1] else (at, 1)
        return (first, n), (event, first, at, n, at - first >= escalate_s)

    return folded(polls, key, ["event_id", "at_s", failed], (0, 0), fold, "first long, fails long", f"{key} long, event_id long, first_s long, last_s long, fails long, escalated boolean")


def blocks(polls: DataFrame, key: str = "key", failed: str = "failed", limit: int = 5) -> DataFrame:
    """(key, event_id, consecutive): the poll at which a source fails for the ``limit``-th time in a row; a success clears it."""

    def fold(now, row):
        n = now[0] + 1 if row[1] else 0
        return (n,), (row[0], n) if n == limit else None

    return folded(polls, key, ["event_id", failed], (0,), fold, "n long", f"{key} long, event_id long, consecutive long")


def silences(polls: DataFrame, key: str = "key", failed: str = "failed", outage_s: int = 86_400) -> DataFrame:
    """(key, event_id, attempts, outage): a row for each attempt that stays without an answer; an answer ends the silence."""

    def fold(now, row):
        event, at, bad = row
        if not bad:
            return (0, 0), None
        first, n = (now[0], now[1] + 1) if now[1] else (at, 1)
        return (first, n), (event, n, at - first >= outage_s)

    return folded(polls, key, ["event_id", "at_s", failed], (0, 0), fold, "first long, attempts long", f"{key} long, event_id long, attempts long, outage boolean")


def behind(polls: DataFrame, key: str = "key", column: str = "behind", limit: int = 2) -> DataFrame:
    """(key, event_id, cycles_behind, fault): a row for each cycle that finds a rebuild behind; catching up clears the count."""

    def fold(now, row):
        n = now[0] + 1 if row[1] else 0
        return (n,), (row[0], n, n >= limit) if row[1] else None

    return folded(polls, key, ["event_id", column], (0,), fold, "n long", f"{key} long, event_id long, cycles_behind long, fault boolean")


def freshest(polls: DataFrame, key: str = "key") -> DataFrame:
    """(key, event_id, newest_s): each report that is newer than all before it of its key."""

    def fold(now, row):
        newer = now[0] is None or row[1] > now[0]
        return (row[1] if newer else now[0],), (row[0], row[1]) if newer else None

    return folded(polls, key, ["event_id", "at_s"], (None,), fold, "newest long", f"{key} long, event_id long, newest_s long")


def retries(polls: DataFrame, key: str = "key", failed: str = "failed", budget: int = 3) -> DataFrame:
    """(key, event_id, state) of each failure: "pending" until the ``budget``-th in a row, then "failed"."""

    def fold(now, row):
        n = now[0] + 1 if row[1] else 0
        return (n,), (row[0], "failed" if n >= budget else "pending") if row[1] else None

    return folded(polls, key, ["event_id", failed], (0,), fold, "n long", f"{key} long, event_id long, state string")


def replay(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that its source holds and returns what it wrote, in append mode."""
    spark = stream.sparkSession
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


__all__ = ["behind", "blocks", "closed_days", "cursors", "faults", "first_inserts", "folded", "freshest", "gaps", "replay", "retries", "silences", "store_days"]
