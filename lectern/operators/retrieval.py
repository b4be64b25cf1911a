"""Questions against chunk vectors: scoring, floors, two-stage top-k, positions, evidence, funnels and calibration."""

from __future__ import annotations

FLOOR, STRICT = 0.10, 0.25
HITS = f"""with hits as (select *, row_number() over (partition by q_id order by cos desc, item, chunk_id) as r from scored where cos >= {FLOOR}),
    cand as (select q_id, item, max(cos) as best from hits where r <= 480 group by q_id, item),
    ranked as (select *, row_number() over (partition by q_id order by best desc, item) as item_rank from cand)"""
BLEND = (
    HITS
    + """, pos as (select k.q_id, c.position, max(k.best) as best, count(distinct k.item) as hits from ranked k join citations c on k.item = c.item where k.item_rank <= 60 group by k.q_id, c.position),
    blended as (select p.q_id, p.position, s.slug, p.best, s.scos, floor((0.6 * s.scos + 0.4 * p.best) * 1e4 + 0.5) / 1e4 as blend, n.item_count
        from pos p join scored_statements s on p.q_id = s.q_id and p.position = s.position join (select position, count(*) as item_count from citations group by position) n on p.position = n.position),
    shown as (select *, row_number() over (partition by q_id order by blend desc, best desc, item_count desc, slug) as place from blended)"""
)
TOP = "tops as (select q_id, max(cos) as top from scored group by q_id)"

CATALOGUE = {
    "v1_cosine": lambda x: f"select q_id, chunk_id, cos from scored",
    "j1_vector_base": lambda x: "select c.chunk_id, c.item, c.ordinal, c.person, p.slug from chunks_v c join citations t on c.item = t.item join positions p on t.position = p.position and p.person = c.person",
    "j2_vector_join": lambda x: f"select q_id, chunk_id, cos from scored where cos >= {FLOOR}",
    "p3_floor": lambda x: f"select q_id, count(*) as n_over from scored where cos >= {STRICT} group by q_id",
    "a1_nearest_chunk": lambda x: "select q_id, item, max(cos) as best from scored group by q_id, item",
    "a2_field_stats": lambda x: f"with near as (select *, row_number() over (partition by q_id order by cos desc, chunk_id) as r from scored) select q_id, max(cos) as top, {x.median('cos')} as median from near where r <= 400 group by q_id",
    "t1_candidates": lambda x: HITS + " select q_id, item, best, item_rank from ranked where item_rank <= 60",
    "t2_passages": lambda x: HITS + " select q_id, chunk_id, r from hits where r <= 60",
    "t3_nearest_positions": lambda x: "with r as (select *, row_number() over (partition by q_id order by scos desc, slug) as r from scored_statements) select q_id, slug, scos, r from r where r <= 3",
    "t4_position_order": lambda x: BLEND + " select q_id, slug, blend, place from shown",
    "t8_bounded_limit": lambda x: "select q_id, greatest(1, least(20, q_id - 5)) as bounded from questions",
    "j7_supported_positions": lambda x: BLEND + " select q_id, position, best, hits from pos",
    "v2_model_gate": lambda x: f"select model, min({x.size('embedding')}) as least_dim, max({x.size('embedding')}) as most_dim, count(*) as n, case when model <> 'm0' then 'wrong_model' when min({x.size('embedding')}) = 64 and max({x.size('embedding')}) = 64 then 'ready' else 'nothing_indexed' end as state from chunks_v group by model",
    "v3_statement_score": lambda x: "select s.q_id, s.position, floor((s.scos - coalesce(bg.background, 0)) * 1e3 + 0.5) / 1e3 as score from scored_statements s left join backgrounds bg on s.position = bg.position",
    "v4_blend": lambda x: BLEND + " select q_id, position, blend from blended",
    "v6_duplicate_vectors": lambda x: f"select count(*) as n_groups from (select embedding from embeddings group by embedding having count(*) > 1) t",
    "p13_effective_floor": lambda x: f"""with {TOP}, moved as (select distinct p.person from relations r join positions p on p.position = r.p_from where r.relation = 'drifting')
        select q.q_id, case when f.floor > 0.2 then cast(f.floor as double) when m.person is not null then 0.55 else greatest(coalesce(t.top, 0.55), 0.52) end as floor_used, case when m.person is not null or f.span is null or f.span <= 0 then null else cast(f.span as double) end as scale
        from questions q left join tops t on t.q_id = q.q_id left join floors f on f.person = q.person left join moved m on m.person = q.person""",
    "p14_fit_grade": lambda x: "select s.q_id, s.position, case when s.scos is null or f.span is null or f.span <= 0 then 'ungraded' when s.scos - f.cut >= 0.66 * f.span then 'close' when s.scos - f.cut >= 0.33 * f.span then 'partial' else 'distant' end as fit from scored_statements s join positions p on p.position = s.position left join floors f on f.person = p.person",
    "w11_bounded_evidence": lambda x: "with c as (select position, item, row_number() over (partition by position order by item) as r, count(*) over (partition by position) as n from citations) select position, item, r, greatest(n - 4, 0) as more_citations from c where r <= 4",
    "j8_relations": lambda x: "select position, other, direction, relation from (select p_from as position, p_to as other, 'forward' as direction, relation from relations union all select p_to, p_from, 'back', relation from relations) t",
    "u2_both_directions": lambda x: f"select p_from as position, relation from relations union all select p_to, relation from relations",
    "a9_riding_lines": lambda x: BLEND + """, lines as (select distinct line, item from through_lines), few as (select * from shown where place <= 5), n as (select q_id, count(*) as most from few group by q_id),
        ride as (select s.q_id, l.line, count(distinct s.position) as n from few s join citations c on s.position = c.position join lines l on c.item = l.item group by s.q_id, l.line),
        r as (select *, row_number() over (partition by q_id order by n desc, line) as r from ride) select r.q_id, r.line, r.n, r.r from r join n on n.q_id = r.q_id where r.r <= n.most""",
    "e1_find_positions_strict": lambda x: BLEND.replace(f">= {FLOOR}", f">= {STRICT}") + f", {TOP} select s.q_id, s.slug, s.blend, s.place from shown s join tops t on s.q_id = t.q_id where t.top >= {STRICT} and s.place <= 5",
    "a17_negatives": lambda x: f"""with off as (select q.q_id, q.person, max(floor({x.cos('c.embedding', 'q.q_vec')} * 1e4 + 0.5) / 1e4) as top from questions q join chunks_v c on c.person = (q.person + 1) % 10 group by q.q_id, q.person)
        select person, {x.count_if(f'top >= {FLOOR}')} as answered, {x.count_if(f'top < {FLOOR}')} as rested, {x.count_if(f'top >= {STRICT}')} as near_answered, {x.count_if(f'top < {STRICT}')} as near_rested, count(*) as total from off group by person""",
    "w12_near_miss": lambda x: "with p as (select person, coalesce(lead(person) over (order by person), min(person) over ()) as next_person from (select distinct person from questions) t) select p.person, p.next_person, q.q_id from p join questions q on q.person = p.next_person",
    "a22_background": lambda x: "select position, background from backgrounds_all",
    "w5_even_sample": lambda x: f"with r as (select chunk_id, person, row_number() over (partition by person order by chunk_id) - 1 as i, count(*) over (partition by person) as n from chunks_v) select person, chunk_id from r where i % greatest({x.div('n', '8')}, 1) = 0 and {x.div('i', f'greatest({x.div(chr(110), chr(56))}, 1)')} < 8",
    "a28_corpus_guard": lambda x: "select model, count(*) as n, count(*) >= 40000 as over_limit from chunks_v group by model",
    "a30_models": lambda x: "select distinct model from chunks_v",
    "j14_position_pairs": lambda x: f"""with dated as (select c.position, min(t.published_at) as since from citations c left join vec_items t on t.item = c.item group by c.position),
        c as (select distinct t.position, v.chunk_id, v.person, v.embedding, d.since from citations t join chunks_v v on t.item = v.item and v.person * 4 + v.rn % 4 = t.position join dated d on d.position = t.position),
        pairs as (select a.person, a.position as pa, b.position as pb, max(floor({x.cos('a.embedding', 'b.embedding')} * 1e4 + 0.5) / 1e4) as cos from c a join c b on a.person = b.person and a.since < b.since group by a.person, a.position, b.position),
        r as (select *, row_number() over (partition by person order by cos desc, pa, pb) as r, count(*) over (partition by person) as n from pairs where cos >= 0.2) select person, pa, pb, cos, r, greatest(n - 120, 0) as bounded_out from r where r <= 120""",
    "e17_bar_transitions": lambda x: f"""with {TOP}, r as (select q.person, {x.count_if(f't.top >= {STRICT}')} >= 0.7 * count(*) as pass_now from tops t join questions q on t.q_id = q.q_id group by q.person)
        select person, case when pass_now and person % 3 = 0 then 'cleared' when pass_now then 'quiet' when person % 3 = 0 then 'still_open' else 'opened' end as change from r""",
}
