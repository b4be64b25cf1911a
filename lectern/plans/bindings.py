"""The corpus tables, bound to the generated tables: people, sources, items, chunks, questions, positions and the rest.

Each view is stated once and named in the order in which views use each other. ``register`` makes them temporary views
of a session; ``prelude`` writes them as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import vectors
from ..sources.sinks import new_folder
from .dialect import Duck, Spark

TABLES = ("documents", "embeddings", "events", "pages", "benchmark", "conversations", "labels")
#: Arrow batches of a query's session: stored cells hold hundreds of kilobytes a row, and Spark's own bound is on rows.
BATCH = "8m"
FLOOR_DATE = "date '2024-03-01'"

VIEWS: dict[str, Callable] = {
    "people": lambda x: "select distinct lang as person, lang = 'fr' as paused from documents",
    "sources": lambda x: f"""select distinct lang as person, source, cast({x.sub("source", "src", "")} as int) as srcno,
        case cast({x.sub("source", "src", "")} as int) % 4 when 0 then 'substack' when 1 then 'youtube' when 2 then 'blog' else 'bluesky' end as platform,
        {FLOOR_DATE} as backfill_floor, cast({x.sub("source", "src", "")} as int) % 3 <> 0 as backfill_complete from documents""",
    "items0": lambda x: f"""select d.doc_id as item_id, d.lang as person, d.source, cast(d.doc_id as {x.string}) as external_id, d.text, l.toxic,
        {x.join(x.slice(x.split("d.text", "\\s+"), 1, 8), " ")} as title, {x.words("d.text")} as words,
        case when d.doc_id % 29 <> 0 then {x.plus_days("date '2024-01-01'", "d.doc_id % 365")} end as published_at
        from documents d left join labels l on d.doc_id = l.doc_id""",
    "items": lambda x: f"""select *, case when toxic = 1 then 'skipped_paywall' when words < 40 then 'skipped_short' when item_id % 17 = 0 then 'failed'
        when item_id % 23 = 0 then 'pending' when published_at < {FLOOR_DATE} then 'skipped_window' else 'retrieved' end as retrieval from items0""",
    "chunks0": lambda x: "select vec_id, label, embedding, row_number() over (partition by label order by vec_id) - 1 as rn from embeddings",
    "chunks_v": lambda x: f"""select vec_id as chunk_id, label as person, embedding, rn, label * 1000 + {x.div("rn", "5")} as item, rn % 5 as ordinal, 'm0' as model from chunks0""",
    "questions": lambda x: "select vec_id as q_id, label as person, embedding as q_vec from embeddings where vec_id % 50 = 0",
    "positions0": lambda x: "select label * 4 + rn % 4 as position, label as person, vec_id, embedding, row_number() over (partition by label * 4 + rn % 4 order by vec_id) as k from chunks0",
    "positions": lambda x: f"select position, person, embedding as s_vec, concat('p-', cast(position as {x.string})) as slug from positions0 where k = 1",
    "citations": lambda x: f"""select distinct c.person * 4 + c.rn % 4 as position, c.item from chunks_v c where c.item % 3 <> 0 and not ((c.person * 4 + c.rn % 4) % 2 = 1 and c.item % 2 = 1)""",
    "relations": lambda x: "select position as p_from, position + 1 as p_to, case position % 3 when 0 then 'revised' when 1 then 'unsettled' else 'drifting' end as relation from positions where position % 2 = 0 and position + 1 in (select position from positions)",
    "scored": lambda x: f"""select q.q_id, q.person, c.chunk_id, c.item, c.ordinal, floor({x.cos("c.embedding", "q.q_vec")} * 1e4 + 0.5) / 1e4 as cos
        from questions q join chunks_v c on q.person = c.person where c.chunk_id <> q.q_id""",
    "scored_statements": lambda x: f"""select q.q_id, p.position, p.slug, floor({x.cos("p.s_vec", "q.q_vec")} * 1e4 + 0.5) / 1e4 as scos from questions q join positions p on q.person = p.person""",
    # a text that holds a quote holds its second to sixth word as words, so these five find the pairs to look at
    "quote_keys": lambda x: f"""select item_id as quote_id, text as quote, {x.join(x.slice(x.split("text", "\\s+"), 2, 5), " ")} as five from benchmark where {x.size(x.split("text", "\\s+"))} >= 7""",
    "text_fives": lambda x: f"""select doc_id, {x.join(x.slice("w", "i", 5), " ")} as five from {x.explode(f"(select doc_id, w, {x.range('1', x.size('w') + ' - 4')} as places from (select doc_id, {x.split('text', chr(92) + 's+')} as w from documents) t where {x.size('w')} >= 5) u", "places", "i")}""",
    "backgrounds": lambda x: f"select p.position, floor(coalesce(avg({x.cos('p.s_vec', 'e.embedding')}), 0) * 1e3 + 0.5) / 1e3 as background from positions p join embeddings e on e.label <> p.person group by p.position",
    "backgrounds_all": lambda x: f"select p.position, floor(coalesce(avg({x.cos('p.s_vec', 'e.embedding')}), 0) * 1e3 + 0.5) / 1e3 as background from positions p cross join embeddings e group by p.position",
    "claims": lambda x: f"""select q.quote_id, d.doc_id as found_in, case when q.quote_id % 5 = 1 then lower(replace(replace(q.quote, '.', ''), ',', '')) else q.quote end as quote, case when q.quote_id % 2 = 0 then d.doc_id else (d.doc_id + 7) % (select count(*) from documents) end as item_id
        from (select distinct k.quote_id, k.quote, f.doc_id from quote_keys k join text_fives f on k.five = f.five) q join documents d on d.doc_id = q.doc_id where {x.locate("q.quote", "d.text")} > 0""",
    # a source is checked by the user of its number; notes stand on the claims that were found in their item
    "checks": lambda x: "select s.person, s.source, s.platform, max(e.ts) as last_checked, max(case s.platform when 'substack' then 24 when 'youtube' then 48 when 'blog' then 72 else 6 end) as every_h from sources s left join events e on e.user_id = s.srcno group by s.person, s.source, s.platform",
    "compiles": lambda x: f"""select i.person, max(case when s.backfill_complete then i.published_at end) as compiled_at, concat('c', cast(count(distinct s.platform) % 2 as {x.string}), '+m0.s1.p', cast(min(s.srcno) % 2 as {x.string}), '.r1') as version
        from items i join sources s on s.person = i.person and s.source = i.source where i.retrieval = 'retrieved' group by i.person""",
    "notes": lambda x: f"select item_id, concat('g', cast(quote_id % 3 as {x.string})) as extractor, count(*) as claims from claims group by item_id, quote_id % 3",
    "replies": lambda x: "select a.conv_id, a.turn, a.text as reply, b.text as record, concat(a.text, case a.turn % 4 when 1 then concat(' “', substring(coalesce(b.text, ''), 1, 30), '” it says') when 3 then ' \"this was never written\" it says' else '' end) as said from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role = 'assistant'",
    "polls": lambda x: f"select user_id, event_id, ts, event_type, value, {x.json_int('props', 'k')} as k, row_number() over (partition by user_id order by ts, event_id) as seq from events",
    "pages_v": lambda x: f"""select page_id, url, html, {x.extract("url", "^https?://([^/]+)")} as host from pages""",
    # what stands on each page of a site: its host, the part of the site, its title
    "site_lines": lambda x: f"""select host, page_id, line from (select host, page_id, host as line from pages_v union all select host, page_id, concat('in ', {x.extract("url", "^https?://[^/]+/([^/?#]*)")}) from pages_v union all select host, page_id, {x.extract("html", "<title>([^<]*)</title>")} from pages_v) t where line <> ''""",
    "site_recent": lambda x: "select l.host, l.page_id, l.line from site_lines l join (select host, page_id, row_number() over (partition by host order by page_id desc) as r from pages_v) p on p.page_id = l.page_id where p.r <= 20",
    "site_repeated": lambda x: "select d.host, d.line, count(*) as on_pages from (select distinct host, page_id, line from site_recent) d join (select host, count(distinct page_id) as pages from site_recent group by host) n on n.host = d.host group by d.host, d.line, n.pages having count(*) >= greatest(2, ceil(n.pages / 2.0))",
    # a source is a video here, its languages are tracks, of which those that nobody judged are machine-made
    "tracks": lambda x: "select d.source as video, d.lang, case when max(l.quality) = 1 then 'manual' else 'asr' end as kind, min(d.doc_id) as pos from documents d left join labels l on l.doc_id = d.doc_id and d.doc_id % 40 < 2 group by d.source, d.lang",
}


#: Views that Spark builds from others by an operator; their statement above is the check's.
BUILT: dict[str, Callable[[SparkSession], DataFrame]] = {
    "scored": lambda s: vectors.score(s.table("questions"), s.table("chunks_v")),
    "scored_statements": lambda s: vectors.score(s.table("questions"), s.sql("select position as chunk_id, person, position as item, 0 as ordinal, s_vec as embedding from positions"), own=True)
    .selectExpr("q_id", "chunk_id as position", "concat('p-', cast(chunk_id as string)) as slug", "cos as scos"),
    "backgrounds": lambda s: vectors.background(s.table("positions"), s.table("embeddings"), others_only=True),
    "backgrounds_all": lambda s: vectors.background(s.table("positions"), s.table("embeddings"), others_only=False),
}


def define_view(name: str, view: Callable) -> str:
    """Adds a view that other modules state, after those it uses."""
    VIEWS[name] = view
    return name


def register(spark: SparkSession, sf_dir: str, statement: str = "", written: tuple[str, ...] = ()) -> SparkSession:
    """A session of its own, so that no view of the caller is replaced, with the tables and the views that the statement
    needs, directly or through others; those ``written`` are stored once, where several others read them."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    texts = {name: view(Spark) for name, view in VIEWS.items()}
    uses = {"scored": "questions chunks_v", "scored_statements": "questions positions", "backgrounds": "positions", "backgrounds_all": "positions"}
    wanted, queue = set(), [statement or " ".join(VIEWS)]
    while queue:
        words = set(re.findall(r"\w+", queue.pop()))
        for name in words & set(texts) - wanted:
            wanted.add(name)
            queue.append(uses.get(name) or texts[name])
    for t in TABLES:
        own.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for name in VIEWS:
        if name in wanted:
            view = BUILT[name](own) if name in BUILT else own.sql(texts[name])
            if name in written:
                path = new_folder(spark, name)
                view.write.parquet(path)
                view = own.read.schema(view.schema).parquet(path)
            view.createOrReplaceTempView(name)
    return own


def prelude() -> str:
    return "with recursive " + ",\n".join(f"{name} as ({view(Duck)})" for name, view in VIEWS.items())


def define(catalogue: dict[str, Callable]) -> tuple[dict[str, Callable], dict[str, str]]:
    """Queries and their check from statements of one dialect argument. A statement may start with its own "with"."""

    def query(statement: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str):
            return register(spark, sf_dir, statement(Spark)).sql(statement(Spark))

        return run

    def check(statement: Callable) -> str:
        text = statement(Duck).strip()
        return prelude() + ((",\n" + text[5:]) if text.startswith("with ") else "\n" + text)

    return {n: query(s) for n, s in catalogue.items()}, {n: check(s) for n, s in catalogue.items()}
