"""The registered ledgers with timers over the events, and SQL that says what is filed from the whole log at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import timers

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
VERSION = "new"


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = F.col("ts").cast("timestamp")
    return s.select(F.col("user_id").alias("key"), at.alias("ts"), F.col("event_id").alias("seq"), F.unix_seconds(at).alias("at_s"), (F.col("event_type") == "error").alias("failed"), F.col("props").alias("detail"), F.lit(0).alias("check"))


def i6_fault_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.replayed(_polls(spark, sf_dir), timers.Faults(), "faults")


def i8_probe_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timers.replayed(_polls(spark, sf_dir), timers.Blocks(limit=3), "blocks")


def i14_heal_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's version is old where the number of its properties is divisible by four."""
    stated = F.when(F.get_json_object("detail", "$.k").cast("long") % 4 == 0, "old").otherwise(VERSION)
    return timers.replayed(_polls(spark, sf_dir).withColumn("detail", stated), timers.Heals(VERSION), "heals")


def i7_silence_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleets of users, whose checks are the users. No SQL: which filing is suppressed depends on all before it."""
    return timers.replayed(_polls(spark, sf_dir).withColumn("check", F.col("key")).withColumn("key", F.col("key") % 10), timers.Silences(), "silences")


def i1_day_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as posts: their kind and properties; clicks have no text."""
    text = F.when(F.col("event_type") != "click", F.concat_ws(" ", "event_type", "props"))
    at = F.col("ts").cast("timestamp")
    s = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    days = timers.replayed_days(s.select(F.col("user_id").alias("key"), at.alias("ts"), F.col("event_id").alias("seq"), F.unix_seconds(at).alias("at_s"), text.alias("text")))
    last = F.element_at("spans", -1)
    return days.select("key", "day", "posts", F.md5("body").alias("body_md5"), F.length("body").cast("long").alias("n_chars"), last["seq"].alias("last_seq"), last["start"].alias("last_start"), F.expr("aggregate(spans, 0L, (a, x) -> a + x.start * 3 + x.end)").alias("span_sum"))


I1 = """with x as (select user_id as key, strftime(ts, '%Y-%m-%d') as day, floor(epoch(ts))::bigint as at_s, event_id as seq, event_type || ' ' || props as t from events where event_type <> 'click' and ts::date < (select max(ts)::date from events where event_type <> 'click')),
    s as (select *, sum(length(t) + 2) over (partition by key, day order by at_s, seq rows unbounded preceding) - 2 as e from x)
    select key, day, count(*) as posts, md5(string_agg(t, chr(10) || chr(10) order by at_s, seq)) as body_md5, max(e)::bigint as n_chars, arg_max(seq, e) as last_seq, max(e - length(t))::bigint as last_start, sum((e - length(t)) * 3 + e)::bigint as span_sum from s group by key, day"""
LOG = """with p as (select user_id as key, event_id, floor(epoch(ts))::bigint as at_s, event_type = 'error' as bad, props as detail, json_extract_string(props, '$.k')::bigint as k from events), e as (select max(at_s) as end_s from p),
    v as (select *, count(*) filter (not bad) over (partition by key order by at_s, event_id rows unbounded preceding) as island, lead(at_s) over (partition by key order by at_s, event_id) as next_s from p),
    f as (select *, min(at_s) over (partition by key, island) as first_s, row_number() over (partition by key, island order by at_s, event_id) as n, count(*) over (partition by key, island) as fails from v where bad),
    c as (select key, island - 1 as island, at_s as pass_s from v where not bad)"""
I6 = LOG + """, due as (select f.*, f.first_s + 86400 as due_s, pass_s from f left join c using (key, island))
    select key, 'opened' as kind, at_s, first_s, at_s as last_s, n, detail from f where n = 1
    union all select key, 'cleared', pass_s, first_s, at_s, n, detail from due where n = fails and pass_s is not null
    union all select key, 'escalated', any_value(due_s), any_value(first_s), arg_max(at_s, n), max(n), arg_max(detail, n) from due, e where at_s <= due_s and (due_s < pass_s or pass_s is null and due_s <= end_s) group by key, island"""
I8 = LOG + """ select key, 'blocked' as kind, at_s, first_s, at_s as last_s, n, detail from f where n = 3
    union all select key, 'probe', at_s + 86400, first_s, at_s, n, detail from f, e where n >= 3 and (at_s + 86400 < next_s or next_s is null and at_s + 86400 <= end_s)
    union all select f.key, 'cleared', pass_s, first_s, at_s, n, detail from f join c on c.key = f.key and c.island = f.island where n = fails and n >= 3"""
I14 = LOG + """, w as (select key, at_s, next_s, min(at_s) over (partition by key) as first_s, row_number() over (partition by key order by at_s, event_id) as n, case when k % 4 = 0 then 'old' else 'new' end as detail,
        lag(at_s) over (partition by key order by at_s, event_id) as was_s, lag(case when k % 4 = 0 then 'old' else 'new' end) over (partition by key order by at_s, event_id) as was from v)
    select key, case detail when 'new' then 'current' else 'stale' end as kind, at_s, first_s, at_s as last_s, n, detail from w where was is null or was <> detail or was_s + 86400 < at_s
    union all select key, 'silent', at_s + 86400, first_s, at_s, n, detail from w, e where at_s + 86400 < next_s or next_s is null and at_s + 86400 <= end_s"""

QUERIES = {"i1_day_bodies": i1_day_bodies, "i6_fault_filings": i6_fault_filings, "i7_silence_filings": i7_silence_filings, "i8_probe_filings": i8_probe_filings, "i14_heal_filings": i14_heal_filings}
ORACLES = {"i1_day_bodies": I1, "i6_fault_filings": I6, "i8_probe_filings": I8, "i14_heal_filings": I14}
