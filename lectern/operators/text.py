"""Text, date, feed and page work as jobs over tables."""

from __future__ import annotations

ACCENT = "'áéíóúàèìòùâêîôûäëïöüñç'", "'aeiouaeiouaeiouaeiounc'"


def _lines(x) -> str:
    return f"lines as (select doc_id, source, line from {x.explode(f"(select doc_id, source, {x.split('text', chr(92) + 'n')} as a from documents) t", 'a', 'line')} where line <> '')"




def SLUG(x, most: int, plain: bool = False) -> str:  # noqa: N802
    """Lower-cased words joined by hyphens, cut at ``most`` characters; with accents taken off unless ``plain``."""
    low = "lower(title)" if plain else f"translate(lower(title), {ACCENT[0]}, {ACCENT[1]})"
    return x.sub(f"substring({x.sub(x.sub(low, '[^a-z0-9]+', '-'), '^-+|-+$', '')}, 1, {most})", "-+$", "")


#: A quoted span of eight characters or more, in straight or curly marks.
QUOTED = "[“\"«]([^“”\"«»]{8,})[”\"»]"
CATALOGUE = {
    "x5_gate_markers": lambda x: f"""select page_id, case when {x.like('html', '(?i)<(?:div|section|aside)[^>]*class=.[^">]*(?:paywall|subscribe|ad)\\b')} then 'widget' when {x.like('html', '(?i)(?:members|subscribers) only|this post is for paid')} then 'phrase' end as gate from pages""",
    "x9_word_count": lambda x: f"select doc_id, {x.words('text')} as words from documents",
    "x11_paragraphs": lambda x: f"""with l as (select doc_id, k, line from {x.posexplode(f"(select doc_id, {x.split('text', chr(92) + 'n')} as a from documents) t", 'a', 'k', 'line')}), o as (select doc_id, k, line, coalesce(sum(length(line) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as at_ from l)
        select doc_id, k, cast(at_ as bigint) as char_start, cast(at_ + length(line) as bigint) as char_end, length(line) as chars from o where line <> ''""",
    "x12_caption_ends": lambda x: "select user_id, event_id, seq, coalesce(lead(seq) over (partition by user_id order by seq), seq + 1) as end_at from polls",
    "x13_day_bodies": lambda x: f"""with p as (select user_id, event_id, ts, {x.iso(x.day('ts'))} as day, concat(event_type, ' ', cast(event_id as {x.string})) as post from events), s as (select *, coalesce(sum(length(post) + 2) over (partition by user_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as at_ from p)
        select user_id, day, event_id, cast(at_ as bigint) as char_start, cast(at_ + length(post) as bigint) as char_end from s""",
    "x14_slugs": lambda x: f"""select item_id, {SLUG(x, 60)} as slug, {SLUG(x, 80)} as line_slug, {SLUG(x, 60, plain=True)} as plain_slug from items""",
    "x15_urls": lambda x: f"select page_id, {x.sub(x.sub('url', '^http://', 'https://'), '/+$', '')} as normal, lower({x.sub(x.sub('url', '^https?://(www\\.)?', ''), '/+$', '')}) as comparable from pages",
    "x16_timecodes": lambda x: f"""with c as (select event_id, k * 61 as s from polls), r as (select event_id, s, case when s >= 3600 then concat(cast({x.div('s', '3600')} as {x.string}), ':', lpad(cast({x.div('s % 3600', '60')} as {x.string}), 2, '0'), ':', lpad(cast(s % 60 as {x.string}), 2, '0')) else concat(cast({x.div('s', '60')} as {x.string}), ':', lpad(cast(s % 60 as {x.string}), 2, '0')) end as code from c),
        p as (select *, {x.split('code', ':')} as a from r) select event_id, s, code, case when {x.size('a')} = 3 then cast({x.at('a', 1)} as bigint) * 3600 + cast({x.at('a', 2)} as bigint) * 60 + cast({x.at('a', 3)} as bigint) else cast({x.at('a', 1)} as bigint) * 60 + cast({x.at('a', 2)} as bigint) end as parsed from p""",
    "x17_months_before": lambda x: f"select item_id, {x.iso(x.months('published_at', -1))} as month_before, {x.days('published_at', x.months('published_at', -1))} as days from items where published_at is not null",
    "x18_quoted_spans": lambda x: f"""with q as (select conv_id, turn, record, q from {x.explode(f"(select conv_id, turn, record, {x.every('said', QUOTED, 1)} as a from replies) t", 'a', 'q')})
        select conv_id, turn, q, record is null or {x.locate('lower(q)', "lower(coalesce(record, ''))")} = 0 as forged from q""",
    "x19_recitations": lambda x: f"""select distinct r.conv_id, r.turn, f.field from replies r join {x.values(["('thnd')", "('position')", "('start_ms')", "('enst')", "('the')", "('chunk_id')", "('confidence')"], 'field')} f on {x.locate('f.field', 'lower(r.reply)')} > 0 and {x.locate('f.field', "lower(coalesce(r.record, ''))")} = 0
        where {x.locate("concat(' ', f.field, ' ')", f"concat(' ', {x.sub('lower(r.reply)', '[^a-z0-9_]+', ' ')}, ' ')")} > 0""",
    "x20_record_lines": lambda x: f"select doc_id, case when {x.like('text', '(?i)https?://')} then 'url' when {x.like('text', '[0-9]{4}-[0-9]{2}-[0-9]{2}')} then 'date' when {x.like('text', '“')} then 'quote' else 'title' end as kind from documents",
    "j13_contains_both_ways": lambda x: f"""with g as (select distinct item_id, person, title, gram from {x.explode(f"(select item_id, person, title, {x.grams('title', 8)} as a from items where length(title) >= 15) t", 'a', 'gram')}),
        inside as (select a.item_id as part, g.item_id as whole from items a join g on g.person = a.person and g.gram = substring(a.title, 1, 8) and g.item_id <> a.item_id where length(a.title) >= 15 and {x.locate('a.title', 'g.title')} > 0),
        both_ as (select part as item_id, whole as other from inside union select whole, part from inside) select item_id, min(other) as held, count(*) as n from both_ group by item_id""",
    "j15_longest_span": lambda x: f"""with a as (select conv_id, turn, p, substring(reply, cast(p as int), 6) as g from {x.explode(f"(select conv_id, turn, reply, {x.range('1', 'greatest(length(reply) - 5, 1)')} as ps from replies where record is not null) t", 'ps', 'p')}),
        b as (select conv_id, turn, p, substring(record, cast(p as int), 6) as g from {x.explode(f"(select conv_id, turn, record, {x.range('1', 'greatest(length(record) - 5, 1)')} as ps from replies where record is not null) t", 'ps', 'p')}),
        m as (select a.conv_id, a.turn, a.p - b.p as diag, a.p from a join b on a.conv_id = b.conv_id and a.turn = b.turn and a.g = b.g where length(a.g) = 6),
        i as (select *, p - row_number() over (partition by conv_id, turn, diag order by p) as island from m),
        r as (select conv_id, turn, diag, island, count(*) as n from i group by conv_id, turn, diag, island) select conv_id, turn, max(n) + 5 as longest from r group by conv_id, turn""",
    "a24_repeated_lines": lambda x: "select host, line, on_pages from site_repeated",
    "x3_without_boilerplate": lambda x: f"select l.host, l.page_id, count(*) as lines_kept, {x.listed('l.line', 'l.line')} as text from site_lines l left join site_repeated o on l.host = o.host and l.line = o.line where o.line is null group by l.host, l.page_id",
    "s4_document_kind": lambda x: f"""select page_id, case when {x.like('head', '(?i)<(rss|feed)[ >]')} then 'feed' when {x.like('head', '(?i)<(urlset|sitemapindex)[ >]')} then 'sitemap' else 'neither' end as kind
        from (select page_id, substring(case page_id % 5 when 0 then concat('<?xml version="1.0"?><rss version="2.0">', html) when 1 then concat('<feed xmlns="a">', html) when 2 then concat('<urlset xmlns="s">', html) when 3 then concat('<sitemapindex>', html) else html end, 1, 2000) as head from pages) t""",
    "s9_caption_track": lambda x: "with r as (select *, row_number() over (partition by video order by case when lang = 'en' then 0 else 1 end, case when kind = 'asr' then 1 else 0 end, pos) as r from tracks) select video, lang, kind from r where r = 1",
    "x16_rough_ages": lambda x: f"""with a as (select event_id, concat(cast(k % 11 + 1 as {x.string}), ' ', case k % 6 when 0 then 'hours' when 1 then 'days' when 2 then 'weeks' when 3 then 'months' when 4 then 'years' else 'views' end, ' ago') as age from polls)
        select a.event_id, a.age, cast({x.extract('a.age', '^([0-9]+) ')} as bigint) * u.days as days_ago from a join {x.values(["('hour', 0)", "('day', 1)", "('week', 7)", "('month', 30)", "('year', 365)"], 'unit', 'days')} u on u.unit = {x.extract('a.age', ' (hour|day|week|month|year)s? ago$')}""",
}
