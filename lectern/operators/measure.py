"""Projections, coverage, census, voice, sampling and claims over the item tables."""

from __future__ import annotations

from ..plans.bindings import FLOOR_DATE
from . import find

SOURCE = "coalesce(s.platform, '?')"
COVER = lambda x: f"""with per as (select s.person, s.source, count(i.item_id) as n, {x.count_if("i.retrieval = 'retrieved'")} as retrieved, {x.count_if("i.retrieval = 'skipped_paywall'")} as paywalled,
        {x.count_if("i.retrieval = 'skipped_short'")} as short_, {x.count_if("i.retrieval = 'failed'")} as failed, {x.count_if("i.retrieval = 'pending'")} as pending, {x.count_if("i.retrieval = 'skipped_window'")} as windowed,
        {x.count_if("i.retrieval = 'retrieved' and i.words >= 300")} as long_form, {x.count_if("i.retrieval = 'retrieved' and i.words < 300")} as short_form,
        cast(coalesce(sum(case when i.retrieval = 'retrieved' then i.words end), 0) as bigint) as words, min(case when i.retrieval = 'retrieved' then i.published_at end) as first_day, max(case when i.retrieval = 'retrieved' then i.published_at end) as last_day
        from sources s left join items i on s.person = i.person and s.source = i.source group by s.person, s.source)"""  # noqa: E731
STOP = "(" + ", ".join(f"'{w}'" for w in find.STOP) + ")"
#: Expressions of each move of a voice and of its registers. A blank or an apostrophe with a mark may be missing.
MOVES = {
    "hedging": ["I think\\b", "I do ?n'?t think\\b", "I'?m not sure\\b", "I could be wrong\\b", "I suspect\\b", "my sense is\\b", "probably\\b", "perhaps\\b", "maybe\\b", "might be\\b", "seems? (?:like|to)\\b", "kind of\\b", "sort of\\b"],
    "direct-address": ["here'?s (?:what|the thing|why|how|where)\\b", "I want you to\\b", "you need to\\b", "you should\\b", "if you'?re\\b", "think about (?:it|this) as\\b", "ask yourself\\b"],
    "enumeration": ["number (?:one|two|three|four|five)\\b", "the (?:first|second|third) thing\\b", "\\b(?:first|second|third|fourth|finally),", "point (?:one|two|three)\\b"],
    "wry-aside": ["frankly\\b", "honestly\\b", "which is (?:wild|nuts|bananas|insane|mad)\\b", "to be fair\\b", "funnily enough\\b"],
    "concession-pivot": ["I'?m not saying\\b", "I'?m just saying\\b", "that said\\b", "having said that\\b", "to be clear\\b", "not to say\\b"],
    "reframe": ["the (?:real )?question is not\\b", "is not (?:which|whether|can|what|how)\\b", "it'?s not (?:about )?\\w+,? it'?s\\b", "rather than asking\\b", "the wrong question\\b"],
}
#: Of the registers, without apostrophes.
REGISTERS = {
    "second": "you youre youve your yours yourself", "first": "i im ive ill me my mine myself", "plural": "we were weve us our ours ourselves",
}


def MOVED(x) -> str:  # noqa: N802
    """(person, words, move, hits): one scan with a count for each move and register, then a row for each.

    Moves are counted by their expressions, ended by ``x.edge``; registers by words, so that words in a row count each.
    """
    edged = lambda v: v.replace("\\b(", x.begin + "(").replace("\\b", x.edge).replace("'", "\\x27")
    moves = {k: x.hits("text", "(?i)" + "|".join(map(edged, alternatives))) for k, alternatives in MOVES.items()}
    registers = {k: x.count_in("ws", words.split()) for k, words in REGISTERS.items()}
    names = {f"m_{k.replace('-', '_')}": k for k in (*moves, *registers)}
    counted = ", ".join(f"{v} as m_{k.replace('-', '_')}" for k, v in {**moves, **registers}.items())
    tall = x.unpivot("counted", ("person", "words"), tuple(names), "move", "hits")
    said = f"said as (select person, words, text, {x.every("replace(lower(text), chr(39), '')", "[a-z0-9_]+")} as ws from items where retrieval = 'retrieved')"
    return f"with {said}, counted as (select person, words, {counted} from said), tall as ({tall}), moved as (select person, words, replace(substring(move, 3, 40), '_', '-') as move, hits from tall)"


#: Settings that somebody asked for: order, platform, handle or none, hours between checks.
OVERRIDES = ["(1, 'blog', null, 12)", "(2, 'blog', 'SRC2', 6)", "(3, 'youtube', null, 24)", "(4, 'blog', 'src1', 3)", "(5, 'podcast', null, 1)"]
OURS = "c0+m0.s1.p0.r1"
#: Rows that break a rule of the tables, by rule; the first part gives each rule a row of its own.
AUDIT = {
    "retrieval": "items where retrieval not in ('retrieved', 'pending', 'failed', 'skipped_short', 'skipped_paywall', 'skipped_window')", "platform": "sources where platform not in ('substack', 'youtube', 'blog', 'bluesky')", "relation": "relations where relation not in ('revised', 'unsettled', 'drifting')",
    "item key": "(select item_id from items group by item_id having count(*) > 1) k", "source key": "(select person, source from sources group by person, source having count(*) > 1) k", "citation key": "(select position, item from citations group by position, item having count(*) > 1) k",
    "slug": "(select person, slug from positions group by person, slug having count(*) > 1) k", "one current": "(select person from compiles group by person having count(*) > 1) k", "person of an item": "(select i.item_id from items i left join people p on p.person = i.person where p.person is null) k",
    "undated": "items where published_at is null", "relation ends": "(select p_from from relations r left join positions p on p.position = r.p_to where p.position is null) k",
}


def GATE(x) -> str:  # noqa: N802
    """A row for each person and check, from facts of its positions, citations, relations and lines."""
    facts = f"""with c as (select p.person, p.position, count(distinct t.item) as n from positions p left join citations t on t.position = p.position group by p.person, p.position),
        v as (select p.person, count(distinct p.s_vec) as vectors from positions p group by p.person), r as (select p.person, count(*) as revised from relations r join positions p on p.position = r.p_from where r.relation = 'revised' group by p.person),
        l as (select p.person, count(distinct t.line) as lines_ from positions p join citations c on c.position = p.position join through_lines t on t.item = c.item group by p.person),
        i as (select person, count(distinct item) as items from chunks_v group by person), e as (select person, count(*) as evidences, count(distinct evidence) as distinct_ from (select p.person, p.position, {x.set_listed(f"cast(c.item as {x.string})")} as evidence from positions p join citations c on c.position = p.position group by p.person, p.position) g group by person),
        f as (select c.person, count(*) as positions, {x.count_if('c.n > 0')} as cited, max(c.n) as most from c group by c.person)"""
    checks = {
        "every position is cited": "f.positions = f.cited", "graded apart": "v.vectors = f.positions", "not collapsed": "coalesce(e.distinct_, 0) * 2 >= coalesce(e.evidences, 0)", "revisions in bounds": "coalesce(r.revised, 0) * 2 <= f.positions",
        "distinct evidence": "coalesce(e.distinct_, 0) = coalesce(e.evidences, 0)", "lines published": "coalesce(l.lines_, 0) > 0", "in proportion": "f.positions <= i.items", "no position takes all": "f.most < i.items",
    }
    joined = "from f left join v on v.person = f.person left join r on r.person = f.person left join l on l.person = f.person left join i on i.person = f.person left join e on e.person = f.person"
    rows = " union all ".join(f"select f.person, '{k}' as check_name, {c} as passed {joined}" for k, c in checks.items())
    return facts + f", rows_ as ({rows}) select person, check_name, passed, min(case when passed then 1 else 0 end) over (partition by person) = 1 as published from rows_"


BANDS = "case when words < 100 then 'a' when words < 400 then 'b' else 'c' end"
CLAIM = "(case when locate_ > 0 then 'verified' else 'dropped' end)"


def _checked(x) -> str:
    loose = lambda c: x.sub(x.sub(f"lower({c})", "[^\\p{L}\\p{N}\\s]", ""), "\\s+", " ")
    return f"with checked as (select c.quote_id, c.item_id, c.quote, d.text, {x.locate('c.quote', 'd.text')} as found_at, {x.locate(x.sub('c.quote', '\\s+', ' '), x.sub('d.text', '\\s+', ' '))} as at_flat, {x.locate(loose('c.quote'), loose('d.text'))} as at_loose from claims c join documents d on c.item_id = d.doc_id)"


CATALOGUE = {
    "s1_items_of_person": lambda x: f"select i.item_id, i.person, s.platform from items i join sources s on i.person = s.person and i.source = s.source join people p on p.person = i.person where not p.paused",
    "p1_date_window": lambda x: "select item_id from items where published_at >= date '2024-02-01' and published_at <= date '2024-06-30'",
    "p2_scope": lambda x: "select item_id from items where person = 'en'",
    "p4_due_sources": lambda x: f"select c.person, c.source, c.last_checked is null as never from checks c join people p on p.person = c.person cross join (select max(ts) as now_ from events) n where not p.paused and (c.last_checked is null or {x.secs('n.now_')} - {x.secs('c.last_checked')} >= c.every_h * 3600 - 3600)",
    "p5_keyword_titles": lambda x: f"""with q0 as (select item_id as asked, person, kw from {x.explode(f"(select item_id, person, {x.split(x.sub('lower(title)', '[^a-z0-9 _-]', ''), ' ')} as a from items where item_id % 50 = 0) t", 'a', 'kw')}),
        q as (select distinct asked, person, kw, substring(kw, 1, 3) as gram from q0 where length(kw) > 2 and kw not in {STOP}),
        t as (select distinct item_id, person, low, gram from {x.explode(f"(select item_id, person, lower(title) as low, {x.grams('lower(title)', 3)} as a from items where retrieval <> 'retrieved') t", 'a', 'gram')})
        select distinct q.asked, t.item_id from t join q on t.person = q.person and t.gram = q.gram and {x.locate('q.kw', 't.low')} > 0""",
    "p6_catalogue_state": lambda x: "select item_id, case when toxic = 1 then 'skipped_paywall' when words < 40 then 'skipped_short' else 'pending' end as state from items",
    "p7_body_verdict": lambda x: "select item_id, case when toxic = 1 then 'gated' when published_at is null then 'not_a_post' when words < 40 then 'short' else 'post' end as verdict from items",
    "p8_audience": lambda x: "select item_id, case when toxic is null then 'unknown' when toxic = 0 then 'everyone' else 'paid' end as audience from items",
    "p9_outside_window": lambda x: f"select item_id from items where published_at is not null and published_at < {FLOOR_DATE}",
    "p10_stale": lambda x: f"with n as (select person, max(published_at) as newest from items where retrieval = 'retrieved' group by person) select p.person, n.newest is not null and (c.compiled_at is null or n.newest > c.compiled_at) as has_unseen, c.version is null or c.version <> '{OURS}' as stale_compiler from people p left join compiles c on c.person = p.person left join n on n.person = p.person",
    "p11_audit": lambda x: "select rule, count(*) as violations from (" + " union all ".join(f"select '{rule}' as rule from {found}" for rule, found in AUDIT.items()) + ") t group by rule",
    "p12_version_parts": lambda x: f"""with v as (select person, {x.split(x.sub("version", "[+]", "."), "[.]")} as a, {x.split(x.sub(f"'{OURS}'", "[+]", "."), "[.]")} as b from compiles),
        p as (select person, k.layer, {" or ".join(f"(k.part = {i} and {x.at('a', i)} <> {x.at('b', i)})" for i in range(1, 6))} as moved, k.part from v cross join {x.values(["(1, 'all')", "(2, 'voice')", "(2, 'coverage')", "(3, 'habits')", "(3, 'through_lines')", "(4, 'positions')", "(5, 'revisions')"], 'part', 'layer')} k)
        select person, layer, moved as withheld from p""",
    "p15_skew": lambda x: COVER(x) + " select person, source, paywalled > retrieved as skewed, case when paywalled + failed + pending > 0 then concat(cast(paywalled as " + x.string + "), ' paid, ', cast(failed as " + x.string + "), ' failed, ', cast(pending as " + x.string + "), ' pending') end as unread from per",
    "p16_pending_disposition": lambda x: f"""select i.item_id, case when i.toxic = 1 then 'skipped_paywall' when s.platform = 'substack' and i.toxic is null and i.published_at < {FLOOR_DATE} then 'skipped_window' when s.platform = 'substack' and i.toxic is null then 'failed'
        when s.platform = 'blog' and i.published_at < {FLOOR_DATE} then 'skipped_window' else 'fetchable' end as disposition from items i join sources s on s.person = i.person and s.source = i.source where i.retrieval = 'pending'""",
    "j3_backlog": lambda x: "select 'unread' as backlog, i.item_id as id from items i left join notes n on n.item_id = i.item_id and n.extractor = 'g0' where i.retrieval = 'retrieved' and n.item_id is null union all select 'undescribed', i.item_id from items i left join labels l on l.doc_id = i.item_id where l.doc_id is null union all select 'uncited', v.chunk_id from chunks_v v left join (select distinct item from citations) c on c.item = v.item where c.item is null",
    "j4_has_citation": lambda x: "select v.chunk_id, c.item is not null as cited from chunks_v v left join (select distinct item from citations) c on v.item = c.item",
    "j5_latest_note": lambda x: f"select user_id, {x.last_by('event_id', x.pair('ts', 'event_id'))} as latest from events group by user_id",
    "j6_covered_items": lambda x: "select p.position, count(distinct v.item) as items, count(distinct c.item) as cited from positions p join chunks_v v on v.person = p.person left join citations c on c.position = p.position and c.item = v.item group by p.position",
    "j10_quote_located": lambda x: _checked(x) + " select quote_id, item_id, found_at, at_flat, case when found_at > 0 then 'exact' when at_flat > 0 then 'flat' else 'missing' end as how from checked",
    "j11_nearly": lambda x: _checked(x) + " select quote_id, item_id from checked where found_at = 0 and at_flat = 0 and at_loose > 0",
    "e6_quote_verification": lambda x: _checked(x) + f" select item_id, {x.count_if('at_flat > 0')} as verified, {x.count_if('at_flat = 0')} as dropped, {x.count_if('at_flat = 0 and at_loose > 0')} as nearly from checked group by item_id",
    "j12_lookup_fallback": lambda x: f"""with refs as (select item_id, person, case when item_id % 4 < 3 then concat('HTTPS://www.x.example/p/', case when item_id % 4 = 2 then '0' else '' end, external_id, '/') end as url, title from items where item_id % 50 = 0),
        urls as (select person, item_id, concat('x.example/p/', external_id) as url from items), titles as (select person, title, min(item_id) as item_id from items group by person, title)
        select r.item_id, coalesce(u.item_id, t.item_id) as found, case when u.item_id is not null then 'url' when t.item_id is not null then 'title' end as how from refs r left join urls u on u.person = r.person and u.url = {x.sub(x.sub('lower(r.url)', '^https?://(www[.])?', ''), '/+$', '')} left join titles t on t.person = r.person and t.title = r.title""",
    "j16_issued_refs": lambda x: "select c.quote_id, i.item_id is not null as issued from claims c left join (select item_id from items where retrieval = 'retrieved') i on c.item_id = i.item_id",
    "j17_ownership_conflict": lambda x: "select p.platform, p.source, count(distinct s.person) as owners from (select distinct platform, source from sources where person = 'en') p join sources s on s.platform = p.platform and s.source = p.source group by p.platform, p.source having count(distinct s.person) > 1",
    "j18_overrides": lambda x: f"""with o as {x.values(OVERRIDES, "ord", "platform", "handle", "hours")},
        m as (select s.person, s.source, o.hours, row_number() over (partition by s.person, s.source order by o.ord desc) as r from sources s join o on s.platform = o.platform and (o.handle is null or lower(o.handle) = lower(s.source)))
        select s.person, s.source, coalesce(m.hours, 48) as hours from sources s left join m on s.person = m.person and s.source = m.source and m.r = 1""",
    "j18_unmatched_overrides": lambda x: f"""with o as {x.values(OVERRIDES, "ord", "platform", "handle", "hours")} select o.ord, o.platform, o.handle from o left join sources s on s.platform = o.platform and (o.handle is null or lower(o.handle) = lower(s.source)) where s.source is null""",
    "j19_key_resolution": lambda x: "select distinct i.item_id from claims c join items i on cast(c.item_id as " + x.string + ") = i.external_id",
    "a3_coverage_by_source": lambda x: COVER(x) + f" select person, source, n, retrieved, paywalled, short_, failed, pending, windowed, long_form, short_form, words, {x.iso('first_day')} as first_day, {x.iso('last_day')} as last_day from per",
    "a4_coverage_by_person": lambda x: COVER(x) + f""", p as (select person, cast(sum(retrieved) as bigint) as retrieved, cast(sum(words) as bigint) as words, max(first_day) as a, min(last_day) as b, {x.listed(f"concat(source, '=', cast(retrieved as {x.string}), '/', cast(n as {x.string}))", 'source')} as by_source from per group by person)
        select person, retrieved, words, by_source, case when a <= b then {x.iso('a')} end as window_start, case when a <= b then {x.iso('b')} end as window_end from p""",
    "a5_state_census": lambda x: "select person, retrieval, count(*) as n from items group by person, retrieval",
    "a6_backlog_owed": lambda x: f"""with owed as (select i.person, {x.count_if("n.item_id is null and i.retrieval = 'retrieved'")} as unread, {x.count_if("i.retrieval = 'pending'")} as unfetched, count(*) as items from items i left join (select distinct item_id from notes where extractor = 'g0') n on n.item_id = i.item_id group by i.person),
        held as (select i.person, count(*) as notes, cast(sum(n.claims) as bigint) as claims from notes n join items i on i.item_id = n.item_id group by i.person) select o.person, o.unread, o.unfetched, o.items, coalesce(h.notes, 0) as notes, coalesce(h.claims, 0) as claims from owed o left join held h on h.person = o.person""",
    "a7_covered_fraction": lambda x: "with t as (select v.person, count(distinct v.item) as items, count(distinct c.item) as cited from chunks_v v left join citations c on c.item = v.item group by v.person) select person, items, cited, floor(cited * 1e4 / items + 0.5) / 1e4 as share, cited * 2 < items as low from t",
    "e15_coverage_report": lambda x: "with t as (select v.person, count(distinct v.item) as items, count(distinct c.item) as cited, count(distinct c.position) as positions from chunks_v v left join citations c on c.item = v.item group by v.person) select person, items, cited, positions, floor(cited * 100.0 / items + 0.5) as percent from t",
    "a8_position_rollup": lambda x: f"""with r as (select c.quote_id % 12 as cluster, c.item_id, i.published_at as d from claims c join items i on c.item_id = i.item_id)
        select cluster, count(distinct item_id) as items, {x.iso('min(d)')} as held_since, {x.iso('max(d)')} as held_until, {x.days('max(d)', 'min(d)')} as days_spanned,
        case when count(distinct item_id) >= 5 and {x.days('max(d)', 'min(d)')} > 7 then 'high' when count(distinct item_id) >= 2 then 'moderate' else 'low' end as confidence from r group by cluster""",
    "a10_line_survival": lambda x: """with e as (select person, item_id % 9 as label, item_id % 4 as reading, item_id from items where retrieval = 'retrieved'),
        g as (select person, label, count(distinct reading) as readings, count(distinct item_id) as items from e group by person, label), dropped as (select person, sum(case when readings < 2 then 1 else 0 end) as singles from g group by person),
        r as (select *, row_number() over (partition by person order by readings desc, items desc, label) as r from g where readings >= 2) select r.person, r.label, r.readings, r.items, r.r, cast(d.singles as bigint) as dropped_singles from r join dropped d on d.person = r.person where r.r <= 4""",
    "a11_habit_evidence": lambda x: f"""with e as (select person, concat('h', cast(item_id % 7 as {x.string})) as slug, count(distinct item_id) as n, {x.sha(x.set_listed(f"cast({x.div('item_id', '7')} as {x.string})"))} as evidence from items where retrieval = 'retrieved' group by person, item_id % 7),
        d as (select *, row_number() over (partition by person, evidence order by slug) as k from e), r as (select *, row_number() over (partition by person order by n desc, slug) as r from d where k = 1) select person, slug, n, r from r where r <= 4""",
    "a12_voice_moves": lambda x: MOVED(x) + " select person, move, cast(sum(hits) as bigint) as occurrences, " + x.count_if("hits > 0") + " as spread, floor(sum(hits) * 1e4 / sum(words) + 0.5) as rate from moved group by person, move",
    "a13_voice_population": lambda x: f"with m as (select *, max(words) over (partition by person) as most from items where retrieval = 'retrieved'), u as (select *, words >= 300 or most < 300 as used from m) select person, {x.count_if('used')} as measured, {x.count_if('not used')} as excluded, {x.low_median('case when used then words end')} as median_words from u group by person",
    "p17_spread_class": lambda x: MOVED(x) + ", s as (select person, move, " + x.count_if("hits > 0") + " as spread, count(*) as n from moved group by person, move) select person, move, case when spread * 3 >= n * 2 then 'characteristic' when spread * 3 >= n then 'occasional' when spread > 0 then 'thin' else 'absent' end as class from s",
    "w6_exemplars": lambda x: f"""with u as (select person, item_id, {x.join(x.slice(x.split('text', chr(92) + 's+'), 1, 60), ' ')} as said, row_number() over (partition by person order by published_at, item_id) - 1 as i, count(*) over (partition by person) as n from items where retrieval = 'retrieved' and published_at is not null)
        select person, item_id, case when length(said) <= 140 then said else {x.sub("substring(said, 1, 140)", " [^ ]*$", "")} end as exemplar from u where i = 0 or i = cast(floor((n - 1) / 2.0 + 0.5) as bigint) or i = n - 1""",
    "a14_scorecard": lambda x: _checked(x) + f""", w as (select *, {x.words('quote')} as qw, {x.words('text')} as tw, length(text) as chars from checked), per as (select quote_id % 3 as generation, item_id, max(tw) as tw from w group by quote_id % 3, item_id), size_ as (select generation, cast(sum(tw) as bigint) as tw, count(*) as items from per group by generation),
        g as (select quote_id % 3 as generation, count(*) as claims, {x.count_if('found_at > 0 or at_flat > 0')} as faithful, {x.count_if('found_at = 0 and at_flat = 0 and at_loose > 0')} as nearly, {x.count_if('found_at > 0 and 3 * found_at >= 2 * chars')} as late, floor({x.median('qw')} + 0.5) as median_quote_words from w group by quote_id % 3)
        select g.generation, claims, faithful, nearly, late, median_quote_words, items, floor(faithful * 1e4 / claims + 0.5) / 1e4 as fidelity, case when claims > faithful then floor(nearly * 1e4 / (claims - faithful) + 0.5) / 1e4 end as punctuation_share, case when s.tw > 0 then floor(claims * 1e6 / s.tw + 0.5) / 1e3 end as claims_per_1k_words from g join size_ s on s.generation = g.generation""",
    "a18_gate_facts": lambda x: f"""with c as (select p.person, p.position, count(distinct t.item) as n from positions p left join citations t on t.position = p.position group by p.person, p.position),
        dup as (select person, count(*) as groups_ from (select person, s_vec from positions group by person, s_vec having count(*) > 1) t group by person), sup as (select p.person, count(distinct r.p_from) as n from relations r join positions p on p.position = r.p_from where r.relation = 'revised' group by p.person)
        select c.person, count(*) as positions, {x.count_if('c.n = 0')} as uncited, max(c.n) as most_citations, coalesce(max(d.groups_), 0) as duplicate_vectors, coalesce(max(s.n), 0) as superseded from c left join dup d on d.person = c.person left join sup s on s.person = c.person group by c.person""",
    "a19_publish_gate": lambda x: GATE(x),
    "a23_most_common": lambda x: f"with c as (select lang, source, count(*) as n, min(doc_id) as first_at from documents group by lang, source), r as (select *, row_number() over (partition by lang order by n desc, first_at) as r from c) select lang, source, n from r where r = 1",
    "a25_publish_rate": lambda x: f"""with s as (select i.person, i.source, max(s.platform) as platform, count(i.published_at) as n, count(distinct i.published_at) as days_, {x.days('max(i.published_at)', 'min(i.published_at)')} as span from items i join sources s on s.person = i.person and s.source = i.source group by i.person, i.source)
        select person, source, platform, n, case when platform = 'bluesky' and span > 0 then least(365.0, floor(days_ * 365.0 / (span + 1) * 100 + 0.5) / 100) when n < 2 or coalesce(span, 0) = 0 then cast(n as double) else floor((n - 1) * 365.0 / span * 100 + 0.5) / 100 end as projected,
        case when platform = 'bluesky' and span > 0 then 'sample days' when n < 2 or coalesce(span, 0) = 0 then 'count' else 'rate' end as basis from s""",
    "a26_archive_survey": lambda x: f"""select s.person, s.source, s.platform, {x.count_if(f'i.published_at >= {FLOOR_DATE} or i.published_at is null')} as in_window, {x.count_if('i.toxic = 1')} as paywalled, {x.count_if(f'(i.published_at >= {FLOOR_DATE} or i.published_at is null) and (i.toxic is null or i.toxic = 0)')} as bodies,
        cast(ceil({x.count_if(f'(i.published_at >= {FLOOR_DATE} or i.published_at is null) and (i.toxic is null or i.toxic = 0)')} * max(case s.platform when 'youtube' then 4 when 'blog' then 2 else 1 end) / 60.0) as bigint) as minutes from sources s join items i on s.person = i.person and s.source = i.source group by s.person, s.source, s.platform""",
    "e18_backfill_plan": lambda x: f"""with s as (select s.person, s.source, s.platform, {x.count_if(f'i.published_at >= {FLOOR_DATE}')} as dated, {x.count_if('i.published_at is null')} as undated, count(distinct i.published_at) as days_, {x.days('max(i.published_at)', 'min(i.published_at)')} as span, count(i.published_at) as n from sources s join items i on s.person = i.person and s.source = i.source group by s.person, s.source, s.platform),
        p as (select *, case when platform in ('blog', 'substack') then cast(dated + undated as double) when platform = 'bluesky' and span > 0 then least(365.0, floor(days_ * 365.0 / (span + 1) + 0.5)) when n < 2 or coalesce(span, 0) = 0 then cast(n as double) else floor((n - 1) * 365.0 / span + 0.5) end as in_window from s)
        select person, source, platform, in_window, case when platform in ('blog', 'substack') then 'counted' else 'projected' end as basis, cast(ceil(in_window * case platform when 'youtube' then 4 when 'blog' then 2 else 1 end / 60.0) as bigint) as minutes from p""",
    "a27_fleet": lambda x: "select person, count(*) as n from items where retrieval = 'retrieved' group by person order by n desc, person",
    "a29_pass_metrics": lambda x: f"""with n as (select quote_id, item_id, row_number() over (order by item_id, quote_id) as ref from (select distinct quote_id, item_id from claims) c), p as (select *, {x.div('ref - 1', '5')} as pass from n), f as (select p.*, c.quote_id is not null as placed from p left join (select distinct c.quote_id, c.item_id from claims c join documents d on d.doc_id = c.item_id and {x.locate('c.quote', 'd.text')} > 0) c on c.quote_id = p.quote_id and c.item_id = p.item_id)
        select pass, count(*) as refs, {x.count_if('placed')} as placed, {x.count_if('not placed')} as omitted, count(distinct item_id) as items, cast(sum({x.count_if('placed')}) over (order by pass) as bigint) as recovered from f group by pass""",
    "a31_sample_description": lambda x: f"select {BANDS} as band, count(*) as items, cast(sum(words) as bigint) as words from items where retrieval = 'retrieved' group by {BANDS}",
    "w1_stratified_sample": lambda x: f"with r as (select item_id, {BANDS} as band, row_number() over (partition by {BANDS} order by md5(external_id)) as r from items where retrieval = 'retrieved') select item_id, band, r from r where r <= 20",
    "w2_sample_with_spill": lambda x: f"""with r as (select item_id, {BANDS} as band, row_number() over (partition by {BANDS} order by md5(external_id)) as r from items where retrieval = 'retrieved'),
        k as (select *, case when r <= 10 then 0 else 1 end as spare from r), n as (select *, row_number() over (order by spare, band, r) as place from k where r <= 30) select item_id, band, place from n where place <= 30""",
    "w3_latest_per_key": lambda x: "with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) select user_id, event_type, event_id from r where r = 1",
    "w7_placement": lambda x: """with f as (select item_id, min(quote_id % 6) as sweep from claims group by item_id), s as (select sweep, count(*) as placed from f group by sweep), every as (select distinct quote_id % 6 as sweep from claims),
        c as (select e.sweep, coalesce(s.placed, 0) as placed from every e left join s on s.sweep = e.sweep), b as (select *, case when placed = 0 and coalesce(lag(placed) over (order by sweep), 1) = 0 then 1 else 0 end as barren from c),
        k as (select *, coalesce(sum(barren) over (order by sweep rows between unbounded preceding and 1 preceding), 0) as stopped from b) select sweep, placed, cast(sum(placed) over (order by sweep) as bigint) as total from k where stopped = 0""",
    "w9_issued_refs": lambda x: f"select c.quote_id, c.item_id, concat('c', cast(row_number() over (partition by i.person order by i.published_at desc nulls last, i.external_id, c.quote_id) as {x.string})) as ref from claims c join items i on c.item_id = i.item_id",
    "w10_unique_slugs": lambda x: f"""with b as (select item_id, person, substring({x.sub(x.sub("lower(title)", "[^a-z0-9]+", "-"), "^-+|-+$", "")}, 1, 6) as base from items), n as (select *, row_number() over (partition by person, base order by item_id) as k from b)
        select item_id, case when k = 1 then base else concat(base, '-', cast(k as {x.string})) end as slug from n""",
    "t6_recent": lambda x: "with r as (select person, item_id, row_number() over (partition by person order by published_at desc nulls last, external_id) as r, count(*) over (partition by person) as n from items) select person, item_id, r, n > 10 as more_available from r where r <= 10",
    "t7_citation_order": lambda x: "select c.position, c.item, row_number() over (partition by c.position order by t.published_at desc nulls last, s.start_at asc nulls first, c.item) as place from citations c left join vec_items t on t.item = c.item left join (select item, min(ordinal) as start_at from chunks_v where ordinal > 0 group by item) s on s.item = c.item",
    "e3_golden_questions": lambda x: "with r as (select item_id, person, title, row_number() over (partition by person order by md5(external_id)) as r from items where retrieval = 'retrieved' and title <> '') select item_id, person, title from r where r <= 9",
    "e7_recent_items": lambda x: f"""with r as (select i.person, i.item_id, i.retrieval, i.published_at, row_number() over (partition by i.person order by i.published_at desc nulls last, i.external_id) as r, count(*) over (partition by i.person) as n from items i),
        note as (select item_id, {x.last_by('extractor', x.pair('extractor', 'claims'))} as extractor, cast(sum(claims) as bigint) as claims from notes group by item_id)
        select r.person, r.item_id, {x.iso('r.published_at')} as published, n.extractor as note, coalesce(n.claims, 0) as claims, r.n > 5 as more_available, case when n.item_id is not null then 'read' when r.retrieval = 'retrieved' then 'not read yet' when r.retrieval = 'skipped_paywall' then 'behind a paywall' when r.retrieval = 'skipped_short' then 'too short' when r.retrieval = 'skipped_window' then 'outside the window' when r.retrieval = 'failed' then 'could not be read' else 'waiting' end as reason
        from r left join note n on n.item_id = r.item_id where r.r <= 5""",
    "e8_personas": lambda x: f"""select p.person, p.paused, max(c.version) as version, {x.iso('max(c.compiled_at)')} as compiled_at, count(s.source) as sources, {x.count_if('not s.backfill_complete')} as blocked, {x.listed('case when not s.backfill_complete then s.source end', 's.source')} as blocked_sources
        from people p left join compiles c on c.person = p.person left join sources s on p.person = s.person group by p.person, p.paused""",
    "e9_layers": lambda x: f"""with v as (select person, {x.split(x.sub("version", "[+]", "."), "[.]")} as a, {x.split(x.sub(f"'{OURS}'", "[+]", "."), "[.]")} as b from compiles)
        select p.person, k.layer, case when v.person is null then 'absent' when p.paused then 'withdrawn' when max(case when {" or ".join(f"(k.part = {i} and {x.at('v.a', i)} <> {x.at('v.b', i)})" for i in range(1, 6))} then 1 else 0 end) = 1 then 'withheld' else 'served' end as state
        from people p left join v on v.person = p.person cross join {x.values(["(1, 'voice')", "(2, 'voice')", "(1, 'coverage')", "(2, 'coverage')", "(1, 'habits')", "(3, 'habits')", "(1, 'positions')", "(4, 'positions')", "(1, 'revisions')", "(5, 'revisions')"], 'part', 'layer')} k group by p.person, p.paused, v.person, k.layer""",
    "e10_measured_layers": lambda x: COVER(x) + " select person, count(*) as sources, cast(sum(retrieved) as bigint) as items, cast(sum(words) as bigint) as words from per group by person",
    "e11_positions_build": lambda x: f"""with refs as (select c.quote_id, c.item_id, c.quote, i.person, i.published_at, concat('c', cast(row_number() over (partition by i.person order by i.published_at desc nulls last, i.external_id, c.quote_id) as {x.string})) as ref from claims c join items i on c.item_id = i.item_id),
        answers as (select person, quote_id % 12 as cluster, case when quote_id % 10 = 9 then concat('x', ref) else ref end as ref from refs where quote_id % 7 <> 6),
        kept as (select a.person, a.cluster, r.item_id, r.quote, r.published_at from answers a join refs r on r.person = a.person and r.ref = a.ref), lost as (select a.person, a.cluster, count(*) as dropped from answers a left join refs r on r.person = a.person and r.ref = a.ref where r.ref is null group by a.person, a.cluster),
        free as (select r.person, count(*) as unabsorbed from refs r left join answers a on a.person = r.person and a.ref = r.ref where a.ref is null group by r.person),
        built as (select person, cluster, count(*) as claims, count(distinct item_id) as items, min(published_at) as since, max(published_at) as until, min(quote) as statement from kept group by person, cluster),
        named as (select *, {x.sub(f"substring({x.sub(x.sub('lower(statement)', '[^a-z0-9]+', '-'), '^-+|-+$', '')}, 1, 24)", "-+$", "")} as base from built), numbered as (select *, row_number() over (partition by person, base order by cluster) as k from named)
        select n.person, n.cluster, n.claims, n.items, {x.iso('n.since')} as held_since, {x.iso('n.until')} as held_until, {x.days('n.until', 'n.since')} as days_spanned, case when n.items >= 5 and {x.days('n.until', 'n.since')} > 7 then 'high' when n.items >= 2 then 'moderate' else 'low' end as confidence,
        case when n.k = 1 then n.base else concat(n.base, '-', cast(n.k as {x.string})) end as slug, coalesce(l.dropped, 0) as dropped, coalesce(f.unabsorbed, 0) as unabsorbed from numbered n left join lost l on l.person = n.person and l.cluster = n.cluster left join free f on f.person = n.person""",
    "e12_revisions": lambda x: f"""with dated as (select p.position, p.person, min(t.published_at) as since from positions p join citations c on c.position = p.position left join vec_items t on t.item = c.item group by p.position, p.person),
        v as (select r.p_from, r.p_to, r.relation, row_number() over (partition by r.p_from, r.p_to order by r.relation) as k from relations r) select v.p_from, v.p_to, v.relation, {x.days('b.since', 'a.since')} as gap_days from v join dated a on a.position = v.p_from join dated b on b.position = v.p_to where v.k = 1 and a.person = b.person and v.relation <> 'drifting' and a.since is not null and b.since is not null""",
    "e13_support_keys": lambda x: f"""with k as (select p.position, {x.sha(f"concat(cast(p.person as {x.string}), '|', p.slug, '|', {x.set_listed(f'cast(c.item as {x.string})')})")} as check_key from positions p join citations c on c.position = p.position group by p.position, p.person, p.slug),
        judged as (select p.position, {x.sha(f"concat(cast(p.person as {x.string}), '|', p.slug, '|', {x.set_listed(f'cast(c.item as {x.string})')})")} as check_key from positions p join citations c on c.position = p.position join vec_items t on t.item = c.item where t.retrieval = 'retrieved' group by p.position, p.person, p.slug)
        select k.position, k.check_key, j.check_key is not null as held from k left join judged j on j.check_key = k.check_key""",
    "e16_generations": lambda x: _checked(x) + f""", r as (select item_id, row_number() over (partition by {BANDS} order by md5(external_id)) as r from items where retrieval = 'retrieved'), sampled as (select item_id from r where r <= 200),
        g as (select c.quote_id % 3 as generation, count(*) as claims, count(distinct c.item_id) as items, {x.count_if('found_at > 0 or at_flat > 0')} as faithful, {x.count_if('found_at = 0 and at_flat = 0 and at_loose > 0')} as nearly from checked c join sampled s on s.item_id = c.item_id group by c.quote_id % 3),
        tall as ({x.unpivot('g', ('generation',), ('claims', 'items', 'faithful', 'nearly'), 'measure', 'n')})
        select measure, cast(coalesce(sum(case when generation = 0 then n end), 0) as bigint) as g0, cast(coalesce(sum(case when generation = 1 then n end), 0) as bigint) as g1, cast(coalesce(sum(case when generation = 2 then n end), 0) as bigint) as g2 from tall group by measure""",
    "u1_held": lambda x: f"select person, slug from positions union select person, concat('line-', cast(position % 5 as {x.string})) from positions",
    "u3_residue": lambda x: "select item_id from items where retrieval = 'retrieved' except select item_id from claims",
    "u4_citation_urls": lambda x: f"select position, {x.set_listed('url')} as urls from (select position, concat('https://x.example/', slug) as url from positions union all select c.position, case when t.published_at is not null then concat('https://x.example/p/', cast(c.item as {x.string})) end from citations c left join vec_items t on t.item = c.item) u where url is not null group by position",
    "u5_merge_groups": lambda x: f"""with groups_ as (select p_from as grp, p_from as member, 0 as k from relations union all select p_from, p_to, 1 from relations),
        mine as (select member, min(grp) as grp from groups_ group by member), rows_ as (select p.position, p.slug, coalesce(m.grp, p.position) as grp from positions p left join mine m on m.member = p.position),
        ev as (select r.grp, c.item from rows_ r join citations c on c.position = r.position group by r.grp, c.item), en as (select grp, count(*) as items from ev group by grp)
        select r.grp, count(*) as members, min(r.position) as at_position, {x.first_by('r.slug', x.pair('length(r.slug)', 'r.position'))} as wording, coalesce(max(en.items), 0) as evidence from rows_ r left join en on en.grp = r.grp group by r.grp""",
    "u6_first_sources": lambda x: "with r as (select source, lang, doc_id, row_number() over (partition by source order by doc_id) as r from documents) select source, lang, doc_id from r where r = 1",
    "n1_claim_rows": lambda x: f"select item_id, k, said from {x.posexplode(f'(select item_id, {x.split("text", "[.] ")} as a from items where retrieval = {chr(39)}retrieved{chr(39)}) t', 'a', 'k', 'said')} where said <> ''",
    "n2_json_path": lambda x: f"""select event_id, {x.json_int('props', 'k')} as k, case when n is not null and n = n and abs(n) < 1e300 then n end as finite from (select event_id, props, {x.try_number(f"case event_id % 4 when 0 then {x.json_str('props', 'k')} when 1 then 'NaN' when 2 then concat('x', {x.json_str('props', 'k')}) else {x.json_str('props', 'none')} end")} as n from events) t""",
    "n3_statements": lambda x: f"select item_id, {x.size(x.slice(x.split('text', '[.] '), 1, 5))} as kept, {x.join(x.slice(x.split('text', '[.] '), 1, 5), ' / ')} as statements from items where retrieval = 'retrieved' and text <> ''",
    "n4_digest_lines": lambda x: f"select item_id, concat_ws(' | ', external_id, substring(title, 1, 40), coalesce({x.iso('published_at')}, 'undated')) as line from items",
}
