"""Ledgers with timers: literal quiet keys, several batches, and brute force over random polls."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lectern.streaming import filings, timers

SF = "/root/testdata/sf0.001"

POLLS = "key long, ts timestamp, seq long, at_s long, failed boolean, detail string, check long"
T0 = 1_704_067_200
H = 3600


def poll(key, hours, failed, detail="", check=0, seq=0):
    at = T0 + int(hours * H)
    return (key, datetime.datetime.fromtimestamp(at, datetime.UTC).replace(tzinfo=None), seq, at, failed, detail, check)


def said(spark, path, batches, ledger):
    """Filings of polls that arrive in batches, as (key, kind, hours, first, last, n, detail)."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, POLLS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    s = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    hours = lambda x: (x - T0) / H
    return sorted((r.key, r.kind, hours(r.at_s), hours(r.first_s), hours(r.last_s), r.n, r.detail) for r in timers.replayed(s, ledger, "filed").collect())


def test_faults_escalate_when_nothing_arrives(spark, tmp_path):
    batches = [[poll(1, 0, True, "a"), poll(2, 0, True), poll(3, 1, True)], [poll(1, 2, True, "b"), poll(2, 3, False)], [poll(9, 30, False)]]
    got = said(spark, tmp_path, batches, timers.Faults())
    assert got == [(1, "escalated", 24, 0, 2, 2, "b"), (1, "opened", 0, 0, 0, 1, "a"), (2, "cleared", 3, 0, 0, 1, ""), (2, "opened", 0, 0, 0, 1, ""), (3, "escalated", 25, 1, 1, 1, ""), (3, "opened", 1, 1, 1, 1, "")]


def test_a_blocked_source_gets_one_probe(spark, tmp_path):
    batches = [[poll(1, k, True, str(k)) for k in range(5)] + [poll(2, 0, True)], [poll(9, 40, False)], [poll(1, 41, True, "probed"), poll(9, 70, False)], [poll(1, 71, False)]]
    got = said(spark, tmp_path, batches, timers.Blocks())
    assert got == [(1, "blocked", 4, 0, 4, 5, "4"), (1, "cleared", 71, 0, 41, 6, "probed"), (1, "probe", 28, 0, 4, 5, "4"), (1, "probe", 65, 0, 41, 6, "probed")]


def test_heals_fall_silent(spark, tmp_path):
    batches = [[poll(1, 0, False, "v2"), poll(2, 0, False, "v1")], [poll(2, 20, False, "v2")], [poll(2, 40, False, "v2"), poll(1, 41, False, "v2")]]
    got = said(spark, tmp_path, batches, timers.Heals("v2"))
    assert got == [(1, "current", 0, 0, 0, 1, "v2"), (1, "current", 41, 0, 41, 2, "v2"), (1, "silent", 24, 0, 0, 1, "v2"), (2, "current", 20, 0, 20, 2, "v2"), (2, "stale", 0, 0, 0, 1, "v1")]


def test_silences_are_filed_together(spark, tmp_path):
    batches = [[poll(1, 0, True, "a", 7), poll(1, 20, True, "b", 8)], [poll(2, 26, False, "", 1)], [poll(1, 27, True, "c", 9), poll(1, 28, False, "", 7)], [poll(1, 29, False, "", 8), poll(2, 60, False, "", 1)]]
    got = said(spark, tmp_path, batches, timers.Silences())
    assert got == [(1, "filed", 24, 0, 0, 1, "a"), (1, "filed", 24, 20, 20, 1, "b"), (1, "filed", 51, 27, 27, 1, "c")]


@pytest.mark.parametrize("cuts", [[], [30, 31, 60], [10, 20, 30, 40, 50, 60, 70]])
def test_batches_do_not_matter(spark, tmp_path, cuts):
    rng = random.Random(4)
    polls = sorted((poll(rng.randrange(4), rng.randrange(0, 90), rng.random() < 0.75, str(k), seq=k) for k in range(80)), key=lambda x: (x[3], x[2]))
    batches = [[p for p in polls if a * H <= p[3] - T0 < b * H] for a, b in zip([0, *cuts], [*cuts, 1000])]
    want, end = [], polls[-1][3]
    for key in {p[0] for p in polls}:
        now, escalated = None, False
        for *_, at, failed, detail, _ in [*(p for p in polls if p[0] == key), (None, None, None, end + 1, None, "", 0)]:
            if now and not escalated and now[0] + 24 * H < at:
                want.append((key, "escalated", now[0] + 24 * H, *now))
                escalated = True
            if failed is None:
                break
            if failed:
                if not now:
                    want.append((key, "opened", at, at, at, 1, detail))
                now = (now[0], at, now[2] + 1, detail) if now else (at, at, 1, detail)
            else:
                if now:
                    want.append((key, "cleared", at, *now))
                now, escalated = None, False
    got = said(spark, tmp_path, [b for b in batches if b], timers.Faults())
    assert got == sorted((k, kind, *((x - T0) / H for x in (at, first, last)), n, d) for k, kind, at, first, last, n, d in want)
    assert any(g[1] == "escalated" for g in got)


def test_silences_against_brute_force(spark):
    """Over the smallest tables, as the registered query is: minute by minute as its rule says."""
    events = sorted((r.ts.replace(tzinfo=datetime.UTC).timestamp() // 1, r.event_id, r.user_id, r.event_type == "error", r.props) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    end, want = events[-1][0], []
    for fleet in range(10):
        open_, own = {}, [e for e in events if e[2] % 10 == fleet]
        for at, _, check, failed, detail in [*own, (end + 1, 0, None, None, "")]:
            if open_ and not any(x[4] for x in open_.values()) and (due := min(x[0] for x in open_.values()) + 86_400) < at:
                want += [(fleet, "filed", due, *x[:4]) for x in open_.values()]
                open_ = {k: (*x[:4], True) for k, x in open_.items()}
            old = open_.pop(check, None)
            if failed:
                open_[check] = (old[0], at, old[2] + 1, detail, old[4]) if old else (at, at, 1, detail, False)
    got = filings.QUERIES["i7_silence_filings"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 10


def test_nothing_and_nulls(spark, tmp_path):
    rows = [(None, None, 0, None, True, None, None), (1, None, 0, None, True, None, None), (*poll(1, 0, True)[:5], None, None)]
    assert [x[1] for x in said(spark, tmp_path, [rows], timers.Faults())] == ["opened"]


@pytest.mark.parametrize("cuts", [[], [5, 24, 25, 50], [1, 2, 3, 30, 47, 48, 49, 71]])
def test_days_close_with_their_bodies(spark, tmp_path, cuts):
    """Posts of a day come in several batches; the last day stays open; a post for a closed day is dropped by the watermark."""
    rng = random.Random(2)
    posts = [(k % 3, T0 + int(h * H), k, None if k % 11 == 0 else f"pöst {k}" * (k % 3)) for k, h in enumerate(sorted(rng.uniform(0, 80) for _ in range(60)))]
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, 1000])):
        own = [(k, datetime.datetime.fromtimestamp(at, datetime.UTC).replace(tzinfo=None), seq, at, text) for k, at, seq, text in posts if a * H <= at - T0 < b * H]
        spark.createDataFrame(own, "key long, ts timestamp, seq long, at_s long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in") if own else None
    s = spark.readStream.schema("key long, ts timestamp, seq long, at_s long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = {(r.key, r.day): r for r in timers.replayed_days(s).collect()}
    want = {}
    for k, at, seq, text in posts:
        day = str(datetime.datetime.fromtimestamp(at, datetime.UTC).date())
        if text and day < "2024-01-04":
            want.setdefault((k, day), []).append((seq, text))
    assert set(got) == set(want)
    for key, own in want.items():
        r = got[key]
        assert r.posts == len(own) and r.body == "\n\n".join(t for _, t in own) and [(x.seq, r.body[x.start : x.end]) for x in r.spans] == own


def test_days_by_sets(spark, tmp_path):
    """Many days close in one batch without a call a day, and a post that comes late for a day that is still open is kept."""
    own = lambda h, seq: [(k, datetime.datetime.fromtimestamp(T0 + h * H, datetime.UTC).replace(tzinfo=None), seq, T0 + h * H, f"p{seq}") for k in range(300)]
    for rows in (own(5, 1) + own(20, 2), own(3, 3), own(50, 4)):
        spark.createDataFrame(rows, "key long, ts timestamp, seq long, at_s long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("key long, ts timestamp, seq long, at_s long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert "TransformWithState" not in timers.day_bodies(s)._jdf.queryExecution().analyzed().toString()
    got = timers.replayed_days(s).collect()
    assert sorted((r.key, r.day, r.posts, r.body) for r in got) == [(k, "2024-01-01", 3, "p3\n\np1\n\np2") for k in range(300)]
    assert {tuple((x.seq, x.start, x.end) for x in r.spans) for r in got} == {((3, 0, 2), (1, 4, 6), (2, 8, 10))}
