"""The queries of ``find`` over the bound tables, with SQL that is stated apart from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.bindings import define_view, prelude, register
from . import calibrate, cells, find, retrieval, vectors

VEC_ITEMS = define_view(
    "vec_items",
    lambda x: """select v.item, v.person, i.title, i.published_at, i.retrieval from (select v.item, v.person, v.item % d.n as doc from (select distinct item, person from chunks_v) v cross join (select count(*) as n from documents) d) v
        left join (select * from items where item_id in (select v.item % d.n from (select distinct item from chunks_v) v cross join (select count(*) as n from documents) d)) i on i.item_id = v.doc""",
)
ASKED = define_view(
    "asked",
    lambda x: f"""select q.q_id, q.person, q.q_vec, v.item, t.title as query, case when q.q_id % 100 = 50 then date '2024-02-01' end as since, case when q.q_id % 200 = 50 then date '2024-11-30' end as until,
        case when q.q_id % 150 = 0 then 3 end as wanted from questions q join chunks_v v on v.chunk_id = q.q_id left join vec_items t on t.item = v.item""",
)
LINES = define_view("through_lines", lambda x: f"select distinct {x.div('position', '3')} as line, item from citations")
WRITTEN = ("chunks_v", "vec_items")
FLOORS = define_view("floors", lambda x: "select person, case when person % 3 = 0 then 0.25 else 0.1 end as floor, 0.05 as cut, case when person <> 4 then 0.3 end as span from (select distinct label as person from embeddings) p")


def searched(spark: SparkSession, sf_dir: str) -> tuple[find.Find, DataFrame]:
    own = register(spark, sf_dir, "asked vec_items through_lines floors citations relations positions backgrounds", WRITTEN)
    chunks = own.sql("select c.chunk_id, c.person, c.item, c.ordinal, c.embedding, t.published_at, coalesce(t.copies, 1) as copies from chunks_v c left join (select item, published_at, count(*) as copies from vec_items group by item, published_at) t on t.item = c.item")
    q = own.table("asked")
    q, floors = q.groupBy(*q.columns).agg(F.count(F.lit(1)).alias("copies")), own.sql("select person, cast(floor as double) as floor, cast(cut as double) as cut, cast(span as double) as span from floors")
    return find.Find(q, chunks, own.table("vec_items"), own.table("positions"), own.table("backgrounds"), own.table("citations"), own.table("relations"), own.table("through_lines"), floors), q.select("q_id", "item", "copies")


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("published_at", F.date_format("published_at", "yyyy-MM-dd")) if "published_at" in df.columns else df


FOUND = """,
    sc as (select q.q_id, q.person, c.chunk_id, c.item, floor(list_cosine_similarity(cast(c.embedding as double[]), cast(q.q_vec as double[])) * 1e4 + 0.5) / 1e4 as cos
        from asked q join chunks_v c on q.person = c.person and c.chunk_id <> q.q_id left join vec_items t on t.item = c.item where (q.since is null or t.published_at >= q.since) and (q.until is null or t.published_at <= q.until)),
    hit as (select s.*, f.floor, row_number() over (partition by q_id order by cos desc, item, chunk_id) as r from sc s join floors f on f.person = s.person),
    fact as (select q.q_id, q.person, f.floor, f.cut, f.span, greatest(1, least(50, coalesce(q.wanted, 10))) as bound, max(h.cos) as top, coalesce(max(h.cos) >= f.floor, false) as selected,
        max(case when h.r = 1 and h.cos >= f.floor and h.item not in (select item from citations) then h.item end) as uncovered from asked q left join floors f on f.person = q.person left join hit h on h.q_id = q.q_id group by q.q_id, q.person, f.floor, f.cut, f.span, q.wanted),
    over as (select q_id, item, max(cos) as best from hit where cos >= floor and r <= 480 group by q_id, item),
    cand as (select * from (select *, row_number() over (partition by q_id order by best desc, item) as item_rank from over) t where item_rank <= 60),
    stat as (select q.q_id, p.position, p.slug, floor(list_cosine_similarity(cast(p.s_vec as double[]), cast(q.q_vec as double[])) * 1e4 + 0.5) / 1e4 as scos from asked q join positions p on p.person = q.person),
    held as (select k.q_id, c.position, max(k.best) as best from cand k join fact f on f.q_id = k.q_id and f.selected and f.uncovered is null join citations c on c.item = k.item group by k.q_id, c.position),
    blended as (select h.*, s.slug, floor((s.scos - coalesce(b.background, 0)) * 1e3 + 0.5) / 1e3 as score, (select count(*) from citations c where c.position = h.position) as item_count from held h join stat s on s.q_id = h.q_id and s.position = h.position left join backgrounds b on b.position = h.position),
    mat as (select b.*, floor((0.6 * score + 0.4 * best) * 1e4 + 0.5) / 1e4 as blend, bound, case when span is null or span <= 0 then 'ungraded' when score - cut >= span * 0.66 then 'close' when score - cut >= span * 0.33 then 'partial' else 'distant' end as fit from blended b join fact f on f.q_id = b.q_id),
    place as (select *, row_number() over (partition by q_id order by blend desc, best desc, item_count desc, slug) as place, count(*) over (partition by q_id) as n from mat),
    shown as (select * from place where place <= bound),
    cit as (select *, greatest(count(*) over (partition by q_id, place) - 4, 0) as more, row_number() over (partition by q_id, place order by published_at desc nulls last, item) as r from (select s.q_id, s.place, c.item, t.published_at from shown s join citations c on c.position = s.position left join vec_items t on t.item = c.item) x),
    rung as (select a.q_id, a.person, f.selected as gate, coalesce(k.item_rank, 0)::bigint as item_rank, (select count(distinct position) from citations c where c.item = a.item) as cites,
        (select min(place) from cit where cit.q_id = a.q_id and cit.item = a.item and cit.r <= 4) as first, (select count(*) from shown s where s.q_id = a.q_id) as n_shown from asked a join fact f on f.q_id = a.q_id left join cand k on k.q_id = a.q_id and k.item = a.item),
    rungs as (select q_id, person, gate, item_rank, cites::bigint as cites, first is not null as reached, coalesce(first = 1, false) as grounded,
        case when not gate then 'silence' when cites = 0 then 'uncovered' when item_rank = 0 then 'withheld' when first is null then 'missed' when first = 1 then 'grounded' else 'outranked' end as rung,
        case when not gate then 'gate' when item_rank = 0 then 'candidate' when cites = 0 then 'no position' when first is null and n_shown = 0 then 'no answer' when first is null then 'not shown' when first > 1 then 'ranked below' end as lost from rung)"""
STOPPED = "[" + ", ".join(f"'{w}'" for w in find.STOP) + "]"
LISTED: dict[str, tuple[Callable[[find.Find, DataFrame], DataFrame], str]] = {
    "e1_find_positions": (lambda f, g: f.answers(), "select q_id, slug, score, blend, fit, item_count, place, greatest(n - bound, 0)::bigint as more from shown"),
    "e1_citations": (lambda f, g: f.cited(), "select q_id, place, item, r, more from cit where r <= 4"),
    "e1_relations": (lambda f, g: f.related(), """select s.q_id, s.slug, p.slug as other, r.relation, r.direction, s.position not in (select p_from from relations where relation = 'revised') as current
        from shown s join (select p_from as position, p_to as e, relation, 'to' as direction from relations union all select p_to, p_from, relation, 'from' from relations) r on r.position = s.position join positions p on p.position = r.e"""),
    "e1_through_lines": (lambda f, g: f.riding(), "select q_id, line, n, r from (select s.q_id, l.line, count(distinct s.position) as n, row_number() over (partition by s.q_id order by count(distinct s.position) desc, l.line) as r from shown s join citations c on c.position = s.position join through_lines l on l.item = c.item group by s.q_id, l.line) t where r <= (select count(*) from shown s where s.q_id = t.q_id)"),
    "e1_passages": (lambda f, g: f.passages(), "select q_id, chunk_id, r, more from (select h.q_id, h.chunk_id, h.r, greatest(count(*) over (partition by h.q_id) - 5, 0) as more from hit h join fact f on f.q_id = h.q_id and f.selected where h.cos >= h.floor and h.r <= 60 and h.q_id not in (select q_id from mat)) t where r <= 5"),
    "e1_nearest_positions": (lambda f, g: f.nearest(), "select * from (select s.q_id, s.slug, row_number() over (partition by s.q_id order by scos desc, s.slug) as r from stat s join fact f on f.q_id = s.q_id where f.uncovered is not null or not f.selected) t where r <= 3"),
    "e1_nothing_matched": (lambda f, g: f.nothing_matched(), "select q_id, floor(top * 1e3 + 0.5) / 1e3 as nearest_similarity, floor::double as floor from fact where not selected and uncovered is null"),
    "e1_read_without_position": (lambda f, g: _day(f.read_without_position()), "select f.q_id, f.uncovered as item, t.title, strftime(t.published_at, '%Y-%m-%d') as published_at from fact f left join vec_items t on t.item = f.uncovered where f.uncovered is not null"),
    "e1_unread_titles": (lambda f, g: f.unread(), f"""select * from (select q_id, item, reason, row_number() over (partition by q_id order by published_at desc nulls last, item) as r from (select a.q_id, t.item, t.retrieval as reason, t.published_at
        from asked a join fact f on f.q_id = a.q_id and not f.selected and f.uncovered is null join vec_items t on t.person = a.person and t.retrieval <> 'retrieved' and t.title is not null
        where len(list_filter(string_split_regex(regexp_replace(lower(a.query), '[^a-z0-9\\s''_-]', '', 'g'), '\\s+'), lambda w: length(w) > 2 and not list_contains({STOPPED}, w) and contains(lower(t.title), w))) > 0) x) y where r <= 3"""),
    "e2_funnel": (lambda f, g: find.funnel(f.rungs(g)), """select person, count(*) as asked, count(*) filter (gate) as gate, count(*) filter (gate and item_rank > 0) as candidate, count(*) filter (gate and item_rank > 0 and cites > 0) as cited,
        count(*) filter (gate and item_rank > 0 and cites > 0 and reached) as reached, count(*) filter (gate and item_rank > 0 and cites > 0 and grounded) as grounded from rungs group by rollup(person)"""),
    "e2_first_loss": (lambda f, g: f.rungs(g).where("lost is not null").groupBy("lost").count().withColumnRenamed("count", "n"), "select lost, count(*) as n from rungs where lost is not null group by lost"),
    "e4_rungs": (lambda f, g: f.rungs(g), "select * from rungs"),
    "a15_rung_histogram": (lambda f, g: find.scorecard(f.rungs(g)).drop("bar", "grounded_rate"), "select person, " + ", ".join(f"count(*) filter (rung = '{r}') as {r}" for r in find.RUNGS) + ", count(*) as asked from rungs group by rollup(person)"),
    "a16_bars": (lambda f, g: find.scorecard(f.rungs(g)).select("person", "grounded_rate", "bar"), "select person, floor(count(*) filter (rung = 'grounded') / count(*) * 1e4 + 0.5) / 1e4 as grounded_rate, case when 10 * count(*) filter (rung = 'grounded') >= 7 * count(*) then 'pass' else 'fail' end as bar from rungs group by rollup(person)"),
    "w4_candidate_rank": (lambda f, g: f.rungs(g).select("q_id", "item_rank"), "select q_id, item_rank from rungs"),
}


FOREIGN = define_view("foreign_probes", lambda x: "select q_id, (person + 1) % 10 as person, q_vec from questions")


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = register(spark, sf_dir, "chunks_v positions foreign_probes")
    return calibrate.floors(own.table("chunks_v"), own.table("positions"), own.table("foreign_probes"))


def _scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = register(spark, sf_dir, "chunks_v positions foreign_probes backgrounds")
    quotes = own.sql("select chunk_id as q_id, person, embedding as q_vec from chunks_v")
    return calibrate.scales(quotes, own.table("positions"), own.table("backgrounds"), own.table("foreign_probes"))


def e14_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, s = _floors(spark, sf_dir), _scales(spark, sf_dir)
    return f.select("person", F.col("level").alias("floor"), F.col("separation").alias("floor_state")).join(s.select("person", F.col("level").alias("cut"), "span", F.col("separation").alias("fit_state")), "person", "full")


LEVEL = """lv as (select person, min(top) filter (inside) as lo, max(top) filter (not inside) as hi, count(*) filter (inside) as n from tops group by person),
    st as (select *, case when n < 4 or hi is null then 'not_measurable' when hi >= lo then 'overlapping' else 'separated' end as separation from lv),
    res as (select person, case when separation = 'separated' then floor((hi + (lo - hi) * 0.25) * 1e4 + 0.5) / 1e4 else FALLBACK end as level, case when separation = 'separated' then floor((lo - hi) * 1e4 + 0.5) / 1e4 end as span, separation,
        case when separation <> 'not_measurable' then floor(lo * 1e4 + 0.5) / 1e4 end as in_low, case when separation <> 'not_measurable' then floor(hi * 1e4 + 0.5) / 1e4 end as out_high from st)"""
_COS = "floor(list_cosine_similarity(cast({a} as double[]), cast({b} as double[])) * 1e4 + 0.5) / 1e4"
FLOOR_SQL = f""", pn as (select *, row_number() over (partition by person order by position) - 1 as i, count(*) over (partition by person) as n from positions),
    probes as (select position as q_id, person, s_vec as v, true as inside from pn where i % greatest(n // 12, 1) = 0 and i // greatest(n // 12, 1) < 12 union all select q_id, person, q_vec, false from foreign_probes),
    tops as (select p.q_id, p.person, p.inside, max({_COS.format(a='c.embedding', b='p.v')}) as top from probes p join chunks_v c on c.person = p.person group by p.q_id, p.person, p.inside), """ + LEVEL.replace("FALLBACK", "0.55")
SCALE_SQL = f""", qn as (select *, row_number() over (partition by person order by chunk_id) - 1 as i, count(*) over (partition by person) as n from chunks_v),
    probes as (select chunk_id as q_id, person, embedding as v, true as inside from qn where n <= 12 or list_contains(list_transform(range(0, 12), lambda k: (k * n) // 12), i) union all select q_id, person, q_vec, false from foreign_probes),
    tops as (select p.q_id, p.person, p.inside, max(floor(({_COS.format(a='c.s_vec', b='p.v')} - coalesce(b.background, 0)) * 1e4 + 0.5) / 1e4) as top from probes p join positions c on c.person = p.person left join backgrounds b on b.position = c.position group by p.q_id, p.person, p.inside), """ + LEVEL.replace("FALLBACK", "null::double")
CALIBRATIONS = {
    "a20_floor_calibration": (_floors, FLOOR_SQL + " select * from res"), "a21_fit_calibration": (_scales, SCALE_SQL + " select * from res"),
    "e14_calibrate": (e14_calibrate, FLOOR_SQL.replace("probes as", "fprobes as").replace("from probes", "from fprobes").replace("tops as", "ftops as").replace("from tops", "from ftops").replace("lv as", "flv as").replace("from lv", "from flv").replace("st as", "fst as").replace("from st)", "from fst)").replace("res as", "fres as")
     + SCALE_SQL + " select coalesce(f.person, s.person) as person, f.level as floor, f.separation as floor_state, s.level as cut, s.span, s.separation as fit_state from fres f full join res s on s.person = f.person"),
}


#: Claims of positions, dated by their position; judgements on pairs, as they arrive, some on pairs that were never sent.
CLAIMS = define_view(
    "position_claims",
    lambda x: """select distinct t.position, v.chunk_id as claim_id, v.person, v.embedding, d.since from citations t join chunks_v v on t.item = v.item and v.person * 4 + v.rn % 4 = t.position
        join (select c.position, min(t.published_at) as since from citations c left join vec_items t on t.item = c.item group by c.position) d on d.position = t.position""",
)
VERDICTS = define_view(
    "pair_verdicts",
    lambda x: f"""select user_id % 10 as person, concat('p', cast({x.div("event_id", "10")} % 140 + 1 as {x.string})) as ref, case event_type when 'purchase' then 'revised' when 'error' then 'unsettled' when 'signup' then 'drifting' else 'none' end as relation,
        props as rationale, event_id as arrived from events""",
)


def _alike(spark: SparkSession, sf_dir: str) -> tuple[SparkSession, DataFrame]:
    own = register(spark, sf_dir, "position_claims pair_verdicts")
    return own, cells.alike(own.sql("select claim_id, person, position, since, embedding from position_claims"), floor=NEAR)


def j14_position_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alike(spark, sf_dir)[1].select("person", "pa", "pb", "cos", "r", "bounded_out")


def j14_nearest_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _alike(spark, sf_dir)[1].select("person", "pa", "pb", "claim_a", "claim_b", "gap_days")


def e12_judged_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _alike(spark, sf_dir)
    return cells.revisions(found, own.table("pair_verdicts")).select("person", "pa", "pb", "relation", "gap_days", "rationale")


def e12_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, found = _alike(spark, sf_dir)
    return cells.judged(found, own.table("pair_verdicts"))


def j2_stored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = register(spark, sf_dir, "chunks_v questions")
    return cells.search(cells.store(own.table("chunks_v")), own.table("questions"), floor=retrieval.FLOOR).select("q_id", "chunk_id", "cos")


def a1_stored_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of each question, by cells that its fifth best so far excludes."""
    own = register(spark, sf_dir, "chunks_v questions")
    return cells.search(cells.store(own.table("chunks_v")), own.table("questions"), k=5).select("q_id", "chunk_id", "cos", "r")


def a17_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = register(spark, sf_dir, "chunks_v foreign_probes questions")
    top = vectors.score(own.table("foreign_probes"), own.table("chunks_v"), k=1, own=True).select("q_id", "cos").join(own.sql("select q_id, person from questions"), "q_id")
    over = lambda floor, name: [F.count_if(F.col("cos") >= floor).alias(f"{name}answered"), F.count_if(F.col("cos") < floor).alias(f"{name}rested")]
    return top.groupBy("person").agg(*over(retrieval.FLOOR, ""), *over(retrieval.STRICT, "near_"), F.count(F.lit(1)).alias("total"))


#: The floor of pairs on the bound vectors, of which none come nearer than 0.4; 0.65 is the operator's own.
NEAR = 0.2
ALIKE_SQL = f""", al as (select a.person, a.position as pa, b.position as pb, a.claim_id as ca, b.claim_id as cb, a.since as sa, b.since as sb, {_COS.format(a="a.embedding", b="b.embedding")} as cos
        from position_claims a join position_claims b on a.person = b.person and a.since < b.since),
    be as (select * from (select *, row_number() over (partition by person, pa, pb order by cos desc, ca, cb) as k from al where cos >= {NEAR}) t where k = 1),
    ra as (select *, row_number() over (partition by person order by cos desc, pa, pb) as r, count(*) over (partition by person) as n from be), pr as (select *, 'p' || r as ref from ra where r <= 120),
    ve as (select * from (select *, row_number() over (partition by person, ref order by arrived) as k from pair_verdicts) t where k = 1)"""
BY_CELLS = {
    "j14_position_pairs": (j14_position_pairs, None), "a17_negatives": (a17_negatives, None),
    "j14_nearest_claims": (j14_nearest_claims, ALIKE_SQL + " select person, pa, pb, ca as claim_a, cb as claim_b, date_diff('day', sa, sb) as gap_days from pr"),
    "e12_judged_revisions": (e12_judged_revisions, ALIKE_SQL + " select pr.person, pa, pb, relation, date_diff('day', sa, sb) as gap_days, rationale from pr join ve on ve.person = pr.person and ve.ref = pr.ref where relation <> 'none'"),
    "e12_judgements": (e12_judgements, ALIKE_SQL + """, co as (select person, ref, count(*) as m from pair_verdicts group by all)
        select coalesce(pr.person, co.person) as person, count(pr.ref) as candidates, count(*) filter (pr.ref is not null and ve.relation <> 'none') as judged, count(*) filter (pr.ref is not null and ve.relation = 'none') as dismissed,
               coalesce(sum(co.m) filter (pr.ref is null), 0)::bigint as dropped_unknown, coalesce(max(greatest(n - 120, 0)), 0) as bounded_out
        from pr full join co on co.person = pr.person and co.ref = pr.ref left join ve on ve.person = co.person and ve.ref = co.ref group by coalesce(pr.person, co.person)"""),
    "j2_stored_cells": (j2_stored_cells, f" select q_id, chunk_id, cos from scored where cos >= {retrieval.FLOOR}"),
    "a1_stored_nearest": (a1_stored_nearest, " select * from (select q_id, chunk_id, cos, row_number() over (partition by q_id order by cos desc, item, chunk_id) as r from scored) t where r <= 5"),
}


def _query(form):
    return lambda spark, sf_dir: form(*searched(spark, sf_dir))


QUERIES = {k: _query(form) for k, (form, _) in LISTED.items()} | {k: q for k, (q, _) in CALIBRATIONS.items()}
ORACLES = {k: prelude() + FOUND + "\n" + sql for k, (_, sql) in LISTED.items()} | {k: prelude() + sql for k, (_, sql) in CALIBRATIONS.items()}
QUERIES |= {k: q for k, (q, _) in BY_CELLS.items()}
ORACLES |= {k: prelude() + sql for k, (_, sql) in BY_CELLS.items() if sql}
