"""Ledgers that speak when nothing arrives: faults, silences, blocked sources and heals with event-time timers.

Each is a stateful processor over the polls of a key in order of (ts, seq). What falls due between two polls is said before
the later one, and what falls due after the last one is said by a timer once the watermark has passed it, so the filings
are the same however the polls are cut into batches. State is held for what is open alone: a pass, an answer or a success
takes it away, with its timer, so healthy keys cost nothing.

Nulls: a poll without a time is never due and is left out, as is one without a key; a null verdict is a pass, a null detail
is empty. Late polls, behind the watermark, are Spark's to drop. An empty stream says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import replay

DAY_S = 86_400
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILED = "key long, kind string, at_s long, first_s long, last_s long, n long, detail string"


class Ledger(StatefulProcessor):
    """A processor whose state is one tuple a key, None while nothing is open; ``poll`` and ``due`` say what to do with it.

    ``poll(state, row)`` gives the next state and rows of FILED without their key; ``due(state)`` is the second at which
    the state speaks by itself, or None, and ``speak(state, at)`` gives what follows then.
    """

    state = ""  # the schema of the tuple

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("open", self.state)

    def poll(self, now: tuple | None, row: Any) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, now: tuple) -> int | None:
        return None

    def speak(self, now: tuple, at: int) -> tuple[tuple | None, list[tuple]]:
        return now, []

    def _late(self, now: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
        out = []
        while now is not None and (at := self.due(now)) is not None and at <= until:
            now, said = self.speak(now, at)
            out += said
        return now, out

    def _keep(self, before: tuple | None, now: tuple | None) -> None:
        for at in list(self.handle.listTimers()) if before is not None else []:
            self.handle.deleteTimer(at)
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
            if (at := self.due(now)) is not None:
                self.handle.registerTimer(at * 1000)

    def _open(self) -> tuple | None:
        return tuple(self.held.get()) if self.held.exists() else None

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now, out = self._open(), []
        before = now
        for row in pd.concat(list(rows)).sort_values(["at_s", "seq"], kind="stable").itertuples(index=False):
            now, said = self._late(now, int(row.at_s) - 1)
            out += said
            now, said = self.poll(now, row)
            out += said
        self._keep(before, now)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in FILED.split(", ")])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self._open()
        now, out = self._late(before, int(expiredTimerInfo.getExpiryTimeInMs()) // 1000)
        if now is None:
            self.held.clear()
        else:
            self.held.update(now)
            if (at := self.due(now)) is not None:
                self.handle.registerTimer(at * 1000)
        yield pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in FILED.split(", ")])

    def close(self) -> None:
        pass


class Faults(Ledger):
    """opened once, when a check first fails; escalated once, a day later if it still does; cleared by a pass. The first
    failure stays, the last one moves, and the detail is the latest."""

    state = "first_s long, last_s long, n long, detail string, escalated boolean"

    def __init__(self, after_s: int = DAY_S):
        self.after_s = after_s

    def poll(self, now, row):
        at, detail = int(row.at_s), row.detail or ""
        if not row.failed:
            return None, [] if now is None else [("cleared", at, *now[:4])]
        if now is None:
            return (at, at, 1, detail, False), [("opened", at, at, at, 1, detail)]
        return (now[0], at, now[2] + 1, detail, now[4]), []

    def due(self, now):
        return None if now[4] else now[0] + self.after_s

    def speak(self, now, at):
        return (*now[:4], True), [("escalated", at, *now[:4])]


class Blocks(Ledger):
    """blocked at the ``limit``-th failure in a row; then one probe is due after ``probe_s``, and after each that fails; a
    success clears. Other polls of a blocked source count as its probe, whenever they come."""

    state = "first_s long, last_s long, n long, detail string, probe_at long"

    def __init__(self, limit: int = 5, probe_s: int = DAY_S):
        self.limit, self.probe_s = limit, probe_s

    def poll(self, now, row):
        at, detail = int(row.at_s), row.detail or ""
        if not row.failed:
            return None, [("cleared", at, *now[:4])] if now is not None and now[2] >= self.limit else []
        n = 1 if now is None else now[2] + 1
        new = (at if now is None else now[0], at, n, detail)
        return (*new, at + self.probe_s if n >= self.limit else -1), [("blocked", at, *new)] if n == self.limit else []

    def due(self, now):
        return None if now[4] < 0 else now[4]

    def speak(self, now, at):
        return (*now[:4], -1), [("probe", at, *now[:4])]


class Heals(Ledger):
    """silent once no report has come for a day; stale at a report of another version than ``version``; current again at
    one of that version. ``detail`` of a poll is the version it reports."""

    state = "first_s long, last_s long, n long, detail string, silent boolean"

    def __init__(self, version: str, after_s: int = DAY_S):
        self.version, self.after_s = version, after_s

    def poll(self, now, row):
        at, detail = int(row.at_s), row.detail or ""
        new = (at if now is None else now[0], at, 1 if now is None else now[2] + 1, detail)
        was = None if now is None else "silent" if now[4] else "current" if now[3] == self.version else "stale"
        kind = "current" if detail == self.version else "stale"
        return (*new, False), [] if kind == was else [(kind, at, *new)]

    def due(self, now):
        return None if now[4] else now[1] + self.after_s

    def speak(self, now, at):
        return (*now[:4], True), [("silent", at, *now[:4])]


class Silences(StatefulProcessor):
    """All checks of a fleet (the key) that get no answer: once one has had none for a day, all open ones are filed together,
    unless one of them is filed already. An answer ends a silence. ``check`` tells the checks of a fleet apart."""

    def __init__(self, after_s: int = DAY_S):
        self.after_s = after_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("open", "check long", "first_s long, last_s long, n long, detail string, filed boolean")

    def _due(self, held: dict[int, tuple]) -> int | None:
        """When all open silences are filed, if nothing else comes."""
        return None if not held or any(x[4] for x in held.values()) else min(x[0] for x in held.values()) + self.after_s

    def _filed(self, held: dict[int, tuple], until: int) -> list[tuple]:
        at = self._due(held)
        if at is None or at > until:
            return []
        out = [("filed", at, *held[check][:4]) for check in sorted(held)]
        held.update({check: (*x[:4], True) for check, x in held.items()})
        return out

    def _read(self) -> dict[int, tuple]:
        return {int(k[0]): tuple(v) for k, v in self.held.iterator()}

    def _write(self, before: dict[int, tuple], held: dict[int, tuple], key: Any, out: list[tuple]) -> pd.DataFrame:
        for check in before.keys() - held.keys():
            self.held.removeKey((check,))
        for check, x in held.items():
            if before.get(check) != x:
                self.held.updateValue((check,), x)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (at := self._due(held)) is not None:
            self.handle.registerTimer(at * 1000)
        return pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in FILED.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self._read()
        held, out = dict(before), []
        for row in pd.concat(list(rows)).sort_values(["at_s", "seq"], kind="stable").itertuples(index=False):
            at, check = int(row.at_s), int(row.check)
            out += self._filed(held, at - 1)
            now = held.pop(check, None)
            if row.failed:
                held[check] = (at if now is None else now[0], at, 1 if now is None else now[2] + 1, row.detail or "", False if now is None else now[4])
        yield self._write(before, held, key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self._read()
        held = dict(before)
        out = self._filed(held, int(expiredTimerInfo.getExpiryTimeInMs()) // 1000)
        yield self._write(before, held, key, out)

    def close(self) -> None:
        pass


BODIES = "key long, day string, posts long, body string, spans array<struct<seq:long,start:long,end:long>>"
#: What stands between two posts of a day.
BREAK = "\n\n"


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BODIES of closed days, whose posts are in order: texts joined, and places by running sums over all days of a batch."""
    for b in batches:
        held = b.column("posts")
        n, flat = held.value_lengths().to_numpy(zero_copy_only=False), held.flatten()
        at = pa.array(np.append(0, np.cumsum(n)), pa.int32())
        seq, text = flat.field("seq"), flat.field("text")
        size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.cumsum(size + len(BREAK)) - size - len(BREAK)
        start = before - np.repeat(before[np.append(0, np.cumsum(n)[:-1])], n) if len(n) else before
        spans = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([seq, pa.array(start), pa.array(start + size)], names=["seq", "start", "end"]))
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("day"), pa.array(n, pa.int64()), pc.binary_join(pa.ListArray.from_arrays(at, text), BREAK), spans], names=["key", "day", "posts", "body", "spans"])


def day_bodies(posts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """BODIES of a stream ``posts(key, ts, seq, at_s, text)``: a row for each UTC day of a key once the watermark has passed it.

    The posts of a key and day are gathered by Spark's own windowed aggregate, put in order of time and number when the day
    closes, and joined by a blank line; no function runs for a single day. A post without text is left out. A batch that
    brings posts to an open day rewrites that day's list; one day of one key is held at a time.
    """
    known = posts.where("key is not null and at_s is not null and ts is not null and text <> ''").select("key", "ts", F.struct("at_s", "seq", "text").alias("post"))
    days = known.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "key").agg(F.array_sort(F.collect_list("post")).alias("posts"))
    day = F.expr(f"cast(date_from_unix_date(cast(unix_seconds(window.start) div {DAY_S} as int)) as string)")
    return days.select(F.col("key").cast("long").alias("key"), day.alias("day"), "posts").mapInArrow(_placed, BODIES)


def filed(polls: DataFrame, ledger: StatefulProcessor, late: str = "0 seconds") -> DataFrame:
    """FILED of a stream ``polls(key, ts, seq, at_s, failed, detail, check)``, in append mode."""
    known = polls.where("key is not null and at_s is not null").select("key", "ts", "seq", "at_s", F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("detail", F.lit("")).alias("detail"), F.coalesce("check", F.lit(0)).cast("long").alias("check"))
    return known.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(statefulProcessor=ledger, outputStructType=FILED, outputMode="Append", timeMode="EventTime")


@contextmanager
def timed_state(spark: SparkSession) -> Iterator[None]:
    """While it lasts, streams that are started keep their state where timers are possible; then the session is as it was."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def replayed_days(posts: DataFrame, name: str = "days") -> DataFrame:
    """The bodies of all days that a stream's source closes."""
    with timed_state(posts.sparkSession):
        return replay(day_bodies(posts), name)


def replayed(polls: DataFrame, ledger: StatefulProcessor, name: str) -> DataFrame:
    """What a ledger says of all that a stream's source holds, up to the last poll's time."""
    with timed_state(polls.sparkSession):
        return replay(filed(polls, ledger), name)
