"""Poll-to-poll semantics over the verdict log, in batch form: cursors, gaps, ledgers, retry and reopen rules."""

from __future__ import annotations

from ..plans.bindings import FLOOR_DATE

RUNS = """with v as (select *, event_type = 'error' as fail, sum(case when event_type = 'error' then 0 else 1 end) over (partition by user_id order by seq rows unbounded preceding) as island from polls),
    run as (select *, row_number() over (partition by user_id, island order by seq) as any_k, sum(case when fail then 1 else 0 end) over (partition by user_id, island order by seq rows unbounded preceding) as run_k from v)"""
CATALOGUE = {
    "i1_closed_days": lambda x: f"with d as (select user_id, {x.day('ts')} as d from events), m as (select max(d) as last_day from d) select d.user_id, {x.iso('d.d')} as day, count(*) as posts from d, m where d.d < m.last_day group by d.user_id, d.d",
    "i3_first_inserts": lambda x: "select user_id, k, min(seq) as first_seq from polls group by user_id, k",
    "i4_cursor": lambda x: "select event_id, max(k) over (partition by user_id order by seq rows unbounded preceding) as cursor_at from polls",
    "i5_gaps": lambda x: "with p as (select *, max(k) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as before from polls) select event_id, before is not null and k > before as reopened from p",
    "i6_fault_ledger": lambda x: RUNS + f" select user_id, island, {x.stamp('min(ts)')} as first_failed_at, {x.stamp('max(ts)')} as last_failed_at, count(*) as fails, {x.hours('max(ts)', 'min(ts)')} >= 24 as escalated from run where fail group by user_id, island",
    "i7_silence_ledger": lambda x: RUNS + f", l as (select user_id, island, count(*) as attempts, {x.hours('max(ts)', 'min(ts)')} as hours from run where fail group by user_id, island) select user_id, count(*) as silences, max(attempts) as most_attempts, {x.any('hours >= 24')} as outage from l group by user_id",
    "i8_blocked": lambda x: RUNS + " select user_id, event_id, cast(run_k as bigint) as consecutive from run where fail and run_k = 5",
    "i9_retry_budget": lambda x: RUNS + " select event_id, case when run_k >= 3 then 'failed' else 'pending' end as state from run where fail",
    "i11_reopen_rules": lambda x: f"select item_id, case when retrieval = 'skipped_window' and published_at >= date '2024-02-01' then 'window_widened' when retrieval = 'skipped_short' then 'shorts_enabled' when retrieval = 'failed' and item_id % 2 = 0 then 'lastmod_moved' end as rule from items where retrieval in ('skipped_window', 'skipped_short', 'failed')",
    "i12_register_sources": lambda x: f"select person, source, case when srcno % 2 = 0 then date '2024-01-01' < backfill_floor else false end as reopened, backfill_complete and not (srcno % 2 = 0) as complete_after from sources",
    "i13_stuck_rebuilds": lambda x: RUNS.replace("'error'", "'click'") + ", last as (select user_id, max(seq) as s from run group by user_id) select r.user_id, cast(r.run_k as bigint) as cycles_behind, r.run_k >= 2 as fault from run r join last l on r.user_id = l.user_id and r.seq = l.s where r.fail",
    "i14_freshness": lambda x: f"with l as (select user_id, max(ts) as newest from events group by user_id), m as (select max(newest) as now_ from l) select l.user_id, case when {x.hours('m.now_', 'l.newest')} >= 24 then 'stale' else 'fresh' end as state from l, m",
    "i15_due_assertions": lambda x: f"""with u as (select distinct user_id from events), a as (select distinct event_type as assertion from events), last_ as (select user_id, event_type, max(ts) as last_at from events group by user_id, event_type), m as (select max(ts) as now_ from events),
        f as (select user_id, max(ts) as failed_at from events where event_type = 'error' group by user_id), p as (select user_id, max(ts) as passed_at from events where event_type <> 'error' group by user_id), c as (select user_id, max(ts) as compiled_at from events where event_type = 'signup' group by user_id)
        select u.user_id, a.assertion, case when f.failed_at is not null and (p.passed_at is null or f.failed_at > p.passed_at) and a.assertion = 'error' then 'fault_open' when l.last_at is null then 'never_asked' when c.compiled_at > l.last_at then 'recompiled' when {x.hours('m.now_', 'l.last_at')} >= 168 then 'weekly' else 'not_due' end as why
        from u cross join a cross join m left join last_ l on l.user_id = u.user_id and l.event_type = a.assertion left join f on f.user_id = u.user_id left join p on p.user_id = u.user_id left join c on c.user_id = u.user_id""",
}
