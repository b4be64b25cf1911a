"""Queries that run the library's jobs over whole tables, with SQL that is stated apart from them.

Documents of other sites are put together by Spark from the given tables, and read back by the job: the SQL takes the
rows that must come out from those tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import chunking, embedding, html
from ..plans.bindings import prelude, register
from ..sources import boilerplate, documents as read, sinks
from ..streaming import streams
from . import contains, find, folds, spans, titles, verify

DIM, BUDGET = 64, 6000
POLLS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = register(spark, sf_dir, "items sources")
    return own.sql("select i.*, s.platform from items i join sources s on i.person = s.person and i.source = s.source")


def _xml(c) -> F.Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def s2_feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, n = _items(spark, sf_dir), F.col("item_id").cast("string")
    day, named = F.date_format("published_at", "dd MMM yyyy"), F.col("item_id") % 13 != 0
    part = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    title, none = part("title", _xml(F.col("title"))), F.lit("")
    rss = F.coalesce(part("pubDate", F.concat(F.lit("Mon, "), day, F.lit(" 00:00:00 +0000"))), none)
    entry = (
        F.when(F.col("platform") == "youtube", F.concat(F.lit("<entry><yt:videoId>v"), n, F.lit("</yt:videoId>"), title, F.coalesce(part("published", F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ssXXX")), none), F.lit("</entry>")))
        .when(F.col("platform") == "blog", F.concat(F.lit("<entry>"), title, F.when(named, F.concat(F.lit('<link rel="alternate" href="https://b.example/'), n, F.lit('?a=1&amp;b=2"/>'))).otherwise(none), F.coalesce(part("updated", F.date_format("published_at", "yyyy-MM-dd")), none), F.lit("</entry>")))
        .otherwise(F.concat(F.lit("<item>"), F.when(named, part("guid", F.concat(F.lit("https://x.example/p/post-"), n))).otherwise(none), F.lit("<title><![CDATA["), F.col("title"), F.lit("]]></title>"), rss, F.lit("</item>")))
    )
    entry = F.when(~F.col("title").contains("]]>"), entry)
    feeds = i.withColumn("e", entry).where("e is not null").groupBy("platform", "person", "source", F.expr("item_id div 50").alias("poll"))
    feeds = feeds.agg(F.concat(F.lit("<rss><channel><title>All of it</title>"), F.array_join(F.array_sort(F.collect_list("e")), "\n"), F.lit("</channel></rss>")).alias("body"))
    out = read.feed_entries(feeds)
    return out.select("platform", "external_id", "url", "title", _stamp("published_at").alias("published"))


S2 = """ select s.platform, case s.platform when 'youtube' then concat('v', item_id) when 'blog' then concat('https://b.example/', item_id, '?a=1&b=2') else concat('post-', item_id) end as external_id,
    case s.platform when 'youtube' then concat('https://www.youtube.com/watch?v=v', item_id) when 'blog' then concat('https://b.example/', item_id, '?a=1&b=2') else concat('https://x.example/p/post-', item_id) end as url,
    trim(title) as title, strftime(published_at, '%Y-%m-%d 00:00:00') as published from items i join sources s on i.person = s.person and i.source = s.source where (s.platform = 'youtube' or item_id % 13 <> 0) and not contains(title, ']]>')"""


def a32_feed_survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each platform's feed entries, those in the window, undated ones included."""
    e = s2_feed_entries(spark, sf_dir)
    return e.groupBy("platform").agg(F.count_if(F.col("published").isNull() | (F.col("published") >= "2024-03-01")).alias("in_window"), F.count_if(F.col("published").isNull()).alias("undated"))


def s3_sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages")
    loc = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("ftp://old.example/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    entry = F.concat(F.lit("<url>\n<loc> "), _xml(loc), F.lit(" </loc>"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<lastmod>2024-05-0"), (F.col("page_id") % 9 + 1).cast("string"), F.lit("</lastmod>"))).otherwise(F.lit("")), F.lit("</url>"))
    maps = p.withColumn("e", entry).groupBy(F.expr("page_id div 50").alias("map")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("e"), ""), F.lit("</urlset>")).alias("body"))
    return read.sitemap_urls(maps).select("loc", F.date_format("lastmod", "yyyy-MM-dd").alias("lastmod"))


S3 = "select trim(url) as loc, case when page_id % 3 = 0 then concat('2024-05-0', page_id % 9 + 1) end as lastmod from pages where page_id % 7 <> 0"


def s5_archive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir)
    link = F.concat(F.lit("https://x.example/p/a%20"), F.col("external_id"))
    record = F.struct(
        F.when(F.col("item_id") % 2 == 0, F.col("external_id")).alias("slug"), F.when(F.col("item_id") % 3 != 0, link).alias("canonical_url"), "title",
        F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("post_date"), F.when(F.col("toxic") == 1, "only_paid").when(F.col("toxic") == 0, "everyone").alias("audience"),
    )
    order = F.struct(F.col("published_at").isNotNull(), -F.unix_date("published_at"), "item_id")
    archives = i.groupBy("person", "source", F.expr("item_id div 200").alias("page")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), record.alias("r")))), lambda x: x["r"])).alias("body"))
    archives = archives.withColumn("handle", F.concat("source", F.lit(".example"))).withColumn("floor", F.lit("2024-03-01").cast("timestamp"))
    return read.archive_items(archives).select("source", "external_id", "url", "title", _stamp("published_at").alias("published"), "audience")


S5 = """ select source, case when item_id % 2 = 0 then external_id else concat('a ', external_id) end as external_id,
    case when item_id % 3 <> 0 then concat('https://x.example/p/a%20', external_id) else concat('https://', source, '.example/p/', external_id) end as url, title,
    strftime(published_at, '%Y-%m-%d 00:00:00') as published, case when toxic is null then 'unknown' when toxic = 0 then 'everyone' else 'paid' end as audience
    from items where (item_id % 2 = 0 or item_id % 3 <> 0) and (published_at is null or published_at >= date '2024-03-01')"""


def s6_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _items(spark, sf_dir)
    text = lambda c: F.struct(c.alias("content"))
    parts = lambda *cs: F.struct(F.array(*[F.struct(text(c).alias("text")) for c in cs]).alias("metadataParts"))
    code = F.concat(F.expr("words div 60").cast("string"), F.lit(":"), F.lpad((F.col("words") % 60).cast("string"), 2, "0"))
    badge = lambda t: F.struct(F.array(F.struct(F.struct(t.alias("text")).alias("thumbnailBadgeViewModel"))).alias("badges"))
    overlays = F.array(F.struct(badge(F.lit("LIVE")).alias("thumbnailBottomOverlayViewModel")), F.struct(badge(F.when(F.col("item_id") % 5 != 0, code)).alias("thumbnailBottomOverlayViewModel")))
    age = F.concat((F.col("item_id") % 11 + 1).cast("string"), F.lit(" days ago"))
    lockup = F.struct(
        F.when(F.col("item_id") % 6 != 0, F.concat(F.lit("v"), "external_id")).alias("contentId"),
        F.struct(F.struct(text(F.col("title")).alias("title"), F.struct(F.struct(F.array(parts(F.lit("a channel")), parts(F.lit("12K views"), age)).alias("metadataRows")).alias("contentMetadataViewModel")).alias("metadata")).alias("lockupMetadataViewModel")).alias("metadata"),
        F.struct(F.struct(overlays.alias("overlays")).alias("thumbnailViewModel")).alias("contentImage"),
    )
    item = F.struct(F.struct(F.struct(lockup.alias("lockupViewModel")).alias("content")).alias("richItemRenderer"))
    pages = d.groupBy("person", F.expr("item_id div 60").alias("page")).agg(F.collect_list(item).alias("grid"))
    tab = lambda grid: F.struct(F.struct(F.struct(F.struct(grid.alias("contents")).alias("richGridRenderer")).alias("content")).alias("tabRenderer"))
    home = tab(F.lit(None).cast(pages.schema["grid"].dataType))
    first = F.to_json(F.struct(F.struct(F.struct(F.array(home, tab(F.col("grid"))).alias("tabs")).alias("twoColumnBrowseResultsRenderer")).alias("contents")))
    more = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("grid").alias("continuationItems")).alias("appendContinuationItemsAction"))).alias("onResponseReceivedActions")))
    return read.listing_videos(pages.select("person", "page", F.when(F.col("page") == 0, first).otherwise(more).alias("body"))).select("person", "video_id", "title", "duration_s", "rough_age")


S6 = " select person, concat('v', external_id) as video_id, title, case when item_id % 5 <> 0 then words end as duration_s, concat(item_id % 11 + 1, ' days ago') as rough_age from items where item_id % 6 <> 0"


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as caption tracks: a line is an event of two segments."""
    cut = lambda x: F.array(F.struct(F.substring(x, F.lit(1), F.expr("3")).alias("utf8")), F.struct(F.substring(x, F.lit(4), F.length(x)).alias("utf8")))
    events = F.transform(F.split("text", "\n"), lambda x, k: F.struct((k * 700).cast("long").alias("tStartMs"), F.when(x != "", cut(x)).alias("segs")))
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.to_json(F.struct(events.alias("events"))).alias("body"))


def s7_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.caption_lines(_tracks(spark, sf_dir)).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.element_at("lines", -1)["at"].alias("last_at"), F.md5("text").alias("text_md5"))


S7 = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as x, unnest(range(0, len(string_split(text, chr(10))))) as k from documents),
    c as (select doc_id, k, trim(regexp_replace(x, '\s+', ' ', 'g')) as x from l)
    select doc_id, count(*) as n_lines, max(k) * 700 as last_at, md5(string_agg(x, ' ' order by k)) as text_md5 from c where x <> '' group by doc_id"""


def s8_own_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    who = lambda mine: F.struct(F.struct(F.when(mine, F.concat(F.lit("did:"), F.col("conv_id").cast("string"))).otherwise("did:other").alias("did")).alias("author"))
    uri = F.concat(F.lit("at://x/post/"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    at = F.lit("2024-04-05T06:07:08Z")
    record = F.struct(F.concat(F.lit(" "), F.col("text"), F.lit(" ")).alias("text"), F.when(F.col("turn") % 2 == 0, at).alias("createdAt"))
    post = F.struct(uri.alias("uri"), F.struct(F.when(F.col("role") == "user", F.concat(F.lit("did:"), F.col("conv_id").cast("string"))).otherwise("did:other").alias("did")).alias("author"), F.when(F.col("turn") % 7 != 5, at).alias("indexedAt"), record.alias("record"))
    entry = F.struct(F.when(F.col("turn") % 5 == 4, "repost").alias("reason"), F.when(F.col("turn") % 3 == 2, F.struct(who(F.col("conv_id") % 2 == 0).alias("parent"))).alias("reply"), post.alias("post"))
    feeds = c.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(entry).alias("feed"))).alias("body")).withColumn("did", F.concat(F.lit("did:"), F.col("conv_id").cast("string")))
    return read.own_posts(feeds).select("conv_id", "rkey", _stamp("posted_at").alias("posted"), F.md5("text").alias("text_md5"))


S8 = """select conv_id, concat(conv_id, '-', turn) as rkey, '2024-04-05 06:07:08' as posted, md5(trim(text)) as text_md5 from conversations
    where role = 'user' and turn % 5 <> 4 and (turn % 3 <> 2 or conv_id % 2 = 0) and trim(text) <> '' and (turn % 2 = 0 or turn % 7 <> 5)"""


def x1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_text(_table(spark, sf_dir, "pages")).select("page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


X1 = r"""with p as (select page_id, regexp_replace(regexp_replace(html, '<(script|style)(\s[^>]*)?>.*?</(script|style)\s*>', '', 'gis'), '<br\s*/?>', chr(10), 'gi') as h from pages),
    b as (select page_id, regexp_replace(regexp_replace(h, '</(p|h[1-6]|li|blockquote|div|figure|figcaption|tr|pre)\s*>', chr(10) || chr(10), 'gi'), '<[^>]*>', '', 'gs') as h from p),
    l as (select page_id, list_transform(string_split(h, chr(10)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\x{00a0}]+', ' ', 'g'))) as a from b),
    t as (select page_id, regexp_replace(regexp_replace(array_to_string(a, chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as t from l)
    select page_id, length(t) as n_chars, md5(t) as text_md5 from t"""


def x2_densest_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_text(_table(spark, sf_dir, "pages"), container=True).select("page_id", "container", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def _page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as their site's: their whole text, in front of it a line of the site, one of its part and one of its language."""
    p = _table(spark, sf_dir, "pages")
    own = p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_extract("html", 'lang="(..)"', 1).alias("lang"))
    return html.page_text(p).join(own, "page_id").select("page_id", "host", F.concat_ws("\n", "host", F.concat(F.lit(" in "), "lang"), "text").alias("text"))


def a24_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.repeated_lines(_page_texts(spark, sf_dir))


def x3_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _page_texts(spark, sf_dir)
    return boilerplate.without_repeated(pages, boilerplate.repeated_lines(pages)).select("host", "page_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


LINED = r"""with p as (select page_id, html as raw, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_replace(regexp_replace(html, '<(script|style)(\s[^>]*)?>.*?</(script|style)\s*>', '', 'gis'), '<br\s*/?>', chr(10), 'gi') as h from pages),
    b as (select page_id, raw, host, regexp_replace(regexp_replace(h, '</(p|h[1-6]|li|blockquote|div|figure|figcaption|tr|pre)\s*>', chr(10) || chr(10), 'gi'), '<[^>]*>', '', 'gs') as h from p),
    t as (select page_id, host, array_to_string([host, 'in ' || regexp_extract(raw, 'lang="(..)"', 1), h], chr(10)) as t from b),
    l as (select page_id, host, k, trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\x{00a0}]+', ' ', 'g')) as line
        from (select page_id, host, unnest(string_split(t, chr(10))) as x, generate_subscripts(string_split(t, chr(10)), 1) as k from t)),
    r as (select * from (select host, page_id, row_number() over (partition by host order by page_id desc) as r from p) where r <= 20),
    o as (select l.host, line, count(distinct page_id) as on_pages from l join r using (host, page_id) where line <> '' group by l.host, line),
    again as (select o.* from o join (select host, count(*) as n from r group by host) n using (host) where on_pages >= greatest(2, ceil(n / 2)))"""
A24 = LINED + " select host, line, on_pages from again"
X3 = LINED + """, k as (select host, page_id, string_agg(line, chr(10) order by k) as t from l where line <> '' and (host, line) not in (select host, line from again) group by host, page_id)
    select p.host, p.page_id, length(coalesce(t, '')) as n_chars, md5(coalesce(t, '')) as text_md5 from p left join k using (host, page_id)"""


def x5_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the marks of a gate put in: a widget, a widget's name in a script alone, or the words, across a line or not."""
    p, k = _table(spark, sf_dir, "pages"), F.col("page_id")
    mark = F.when(k % 5 == 0, '<div class="gh-post-upgrade-cta">Join</div>').when(k % 5 == 1, "<script>x='gh-post-upgrade-cta'</script>").otherwise("")
    said = F.when(k % 3 == 0, "<p>This post is for <b>paying</b> subscribers</p>").when(k % 3 == 1, "<p>This post is for all.</p><p>Members too</p>").otherwise("")
    marked = p.select("page_id", F.concat("html", mark, said).alias("html"))
    return marked.join(html.page_text(marked).select("page_id", "text"), "page_id").select("page_id", boilerplate.gate(F.col("html"), F.col("text")).alias("gate"))


X5 = "select page_id, case when page_id % 5 = 0 then 'gh-post-upgrade-cta' when page_id % 3 = 0 then 'members-cta-copy' end as gate from pages"


def j15_shared_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest span of each reply with what was said before it, and of each with the record of the conversation after."""
    own = register(spark, sf_dir, "replies")
    r = contains.written(own.table("replies").select("conv_id", "turn", "said", "record"), "replies")
    said = r.select("conv_id", "turn", "said").distinct().withColumn("other", F.explode(F.array("conv_id", F.col("conv_id") + 1)))
    return spans.longest_by_record(said, r.select(F.col("conv_id").alias("other"), "record"), own.sql("select doc_id as other, text as body from documents"))


def x4_feed_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "pages").where("not contains(html, ']]>')")
    has = lambda k, name, inner: F.when(F.col("page_id") % k != 0, F.concat(F.lit(f"<{name}>"), inner, F.lit(f"</{name}>"))).otherwise(F.lit(""))
    entry = F.concat(has(2, "summary", _xml(F.col("url"))), has(5, "description", F.lit("&lt;p&gt;short&lt;/p&gt;")), has(3, "content:encoded", F.concat(F.lit("<![CDATA["), F.col("html"), F.lit("]]>"))))
    body = read.feed_body(entry)
    return p.select("page_id", body["element"].alias("element"), body["whole"].alias("whole"), F.md5(body["html"]).alias("body_md5"))


X4 = r"""select page_id, case when page_id % 3 <> 0 then 'content:encoded' when page_id % 5 <> 0 then 'description' when page_id % 2 <> 0 then 'summary' end as element,
    case when page_id % 3 <> 0 then true when page_id % 5 <> 0 or page_id % 2 <> 0 then false end as whole,
    md5(case when page_id % 3 <> 0 then trim(replace(replace(replace(replace(replace(replace(replace(html, '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(10) || chr(9) || chr(13) || ' ')
        when page_id % 5 <> 0 then '<p>short</p>' when page_id % 2 <> 0 then url end) as body_md5 from pages where not contains(html, ']]>')"""


def x6_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with statements of its date put into its head: of several, or one that is no date, the first that is one counts."""
    p = _table(spark, sf_dir, "pages")
    k, day = F.col("page_id"), F.concat(F.lit("2024-03-0"), (F.col("page_id") % 9 + 1).cast("string"))
    head = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("<meta content='"), F.when(k % 6 == 0, F.lit("no date")).otherwise(day), F.lit("T08:00:00+02:00' property='article:published_time' />"))).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"Article", "datePublished" : "'), day, F.lit('"}</script>'))).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit('<time class="x" datetime="2023-12-31T23:59:00Z">then</time>')).otherwise(F.lit("")),
    )
    out = p.select("page_id", read.published(F.concat(F.lit("<html>"), head, F.col("html"))).alias("d"))
    return out.select("page_id", _stamp("d.at").alias("published"), "d.found_in")


X6 = """with d as (select page_id, concat('2024-03-0', page_id % 9 + 1) as day, page_id % 2 = 0 and page_id % 6 <> 0 as meta, page_id % 3 = 0 as ld, page_id % 5 = 0 as t from pages)
    select page_id, case when meta then day || ' 06:00:00' when ld then day || ' 00:00:00' when t then '2023-12-31 23:59:00' end as published, case when meta then 'article:published_time' when ld then 'json-ld' when t then 'time' end as found_in from d"""


def _feed_text(every: str = "text"):
    """A document as its feed gives it: without every fifth line, or with more words than the page has."""
    fewer = F.array_join(F.filter(F.split(every, "\n"), lambda x, k: k % 5 != 0), "\n")
    return F.when(F.col("doc_id") % 4 == 0, F.concat(F.col(every), F.lit("\nread on at our site"))).otherwise(fewer)


def x7_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").where("text is not null")
    return read.agreement(d, "doc_id", F.col("text"), _feed_text()).select("doc_id", (F.floor(F.col("share") * 1e4 + 0.5) / 1e4).alias("share"))


FED = r"""with d as (select doc_id, text, case when doc_id % 4 = 0 then concat(text, chr(10), 'read on at our site') else array_to_string(list_filter(string_split(text, chr(10)), lambda x, k: (k - 1) % 5 <> 0), chr(10)) end as fed from documents where text is not null),
    w as (select doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') as p, list_filter(string_split_regex(lower(fed), '\s+'), lambda x: x <> '') as f from d)"""
X7 = FED + " select doc_id, case when len(p) = 0 then 0.0 else floor(len(list_filter(p, lambda x: list_contains(f, x))) / len(p) * 1e4 + 0.5) / 1e4 end as share from w"


def x8_longer_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != ""))
    return _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.when(words(F.col("text")) > words(_feed_text()), "page").otherwise("feed").alias("body_from"))


X8 = FED + " select doc_id, case when len(p) > len(f) then 'page' else 'feed' end as body_from from w"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_items(_table(spark, sf_dir, "documents"), key="doc_id")


def x10_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(F.col("item_id").alias("doc_id"), "ordinal", "char_start", "char_end", F.md5("text").alias("text_md5"))


#: Units of a text, then windows over them, by recursion over the sets; nothing of the operator is used.
CHUNKED = r"""with recursive p0 as (select doc_id, text, unnest(string_split(text, chr(10))) as x, unnest(range(0, len(string_split(text, chr(10))))) as k from documents where text is not null),
    p1 as (select doc_id, text, x, k, coalesce(sum(length(x) + 1) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as b0 from p0),
    p2 as (select doc_id, text, b0 + length(x) - length(regexp_replace(x, '^\s+', '')) as s, b0 + length(regexp_replace(x, '\s+$', '')) as e from p1 where regexp_replace(x, '\s+', '', 'g') <> ''),
    cuts as (select doc_id, text, s, e, case when e - s <= 1500 then e else null end as c from p2
        union all select doc_id, text, n, e, case when e - n <= 1500 then e end from (
            select doc_id, text, e, case when blank > 1000 then s + blank + 1 else s + 1500 + case when substr(text, (s + 1501)::bigint, 1) = ' ' then 1 else 0 end end as n
            from (select doc_id, text, s, e, 1501 - case when contains(substr(text, (s + 1)::bigint, 1501), ' ') then strpos(reverse(substr(text, (s + 1)::bigint, 1501)), ' ') else 1502 end as blank from cuts where c is null) q) r),
    ends as (select doc_id, s, coalesce(c, case when blank > 1000 then s + blank else s + 1500 end) as e from
        (select *, 1501 - case when contains(substr(text, (s + 1)::bigint, 1501), ' ') then strpos(reverse(substr(text, (s + 1)::bigint, 1501)), ' ') else 1502 end as blank from cuts) q),
    u as (select doc_id, s, e, row_number() over (partition by doc_id order by s) as i, count(*) over (partition by doc_id) as n from ends),
    lasts as (select a.doc_id, a.i, a.s, a.n, greatest(a.i, max(b.i)) as l from u a join u b on a.doc_id = b.doc_id and b.i >= a.i and b.i <= a.i + 1500 and (b.e - a.s <= 1500 or b.i = a.i) group by a.doc_id, a.i, a.s, a.n),
    nexts as (select w.doc_id, w.i, w.s, w.n, w.l, max(z.e) as e, greatest(w.i + 1, coalesce(min(b.i) filter (b.i >= w.i + 1 and z.e - b.s <= 200), w.l)) as nx
        from lasts w join u z on z.doc_id = w.doc_id and z.i = w.l join u b on b.doc_id = w.doc_id and b.i between w.i and w.l group by w.doc_id, w.i, w.s, w.n, w.l),
    run as (select doc_id, 0 as ordinal, i, s, e, l, n, nx from nexts where i = 1
        union all select r.doc_id, r.ordinal + 1, x.i, x.s, x.e, x.l, x.n, x.nx from run r join nexts x on x.doc_id = r.doc_id and x.i = r.nx where r.l < r.n)"""
X10 = CHUNKED + " select doc_id, ordinal::bigint as ordinal, s::bigint as char_start, e::bigint as char_end, md5(substr(text, (s + 1)::bigint, (e - s)::bigint)) as text_md5 from run join documents using (doc_id)"


def j9_chunk_of_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = register(spark, sf_dir, "claims")
    found = own.sql("select c.quote_id, c.item_id, cast(locate(c.quote, d.text) - 1 as bigint) as at from claims c join documents d on c.item_id = d.doc_id where locate(c.quote, d.text) > 0")
    return chunking.chunk_of(found, _chunks(own, sf_dir)).select("quote_id", "item_id", F.col("at").alias("found_at"), "ordinal")


J9 = CHUNKED + r""", q as (select b.item_id as quote_id, d.doc_id as found_in, case when b.item_id % 5 = 1 then lower(replace(replace(b.text, '.', ''), ',', '')) else b.text end as quote from benchmark b join documents d on strpos(d.text, b.text) > 0 where len(string_split_regex(b.text, '\s+')) >= 7),
    c as (select quote_id, quote, case when quote_id % 2 = 0 then found_in else (found_in + 7) % (select count(*) from documents) end as item_id from q),
    f as (select quote_id, item_id, strpos(d.text, quote) - 1 as at_ from c join documents d on d.doc_id = c.item_id where strpos(d.text, quote) > 0)
    select quote_id, item_id, at_ as found_at, min(ordinal)::bigint as ordinal from f left join run r on r.doc_id = f.item_id and at_ >= r.s and at_ < r.e group by all"""


def v5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of documents embedded in two runs, of which the second finds a part of its backlog done; a row for each number that is not 0."""
    c = _chunks(spark, sf_dir).withColumn("chunk_id", F.concat_ws("-", "item_id", "ordinal"))
    first = embedding.embed_missing(c.where("item_id % 3 = 0"), None, "hashed", embedding.hashed_words(DIM), DIM)
    path = sinks.new_folder(spark, "embeddings")
    first.write.parquet(path)
    held = spark.read.parquet(path)
    every = held.unionByName(embedding.embed_missing(c, held, "hashed", embedding.hashed_words(DIM), DIM))
    return every.select("chunk_id", F.posexplode("embedding").alias("i", "v")).where("v <> 0").select("chunk_id", F.col("i").cast("long").alias("place"), F.col("v").cast("double").alias("weight"))


V5 = CHUNKED + rf""", t as (select concat(doc_id, '-', ordinal) as chunk_id, lower(substr(text, (s + 1)::bigint, (e - s)::bigint)) as x from run join documents using (doc_id)),
    w as (select chunk_id, unnest(list_filter(string_split_regex(x, '[^a-z0-9]+'), lambda y: length(y) >= 4)) as w from t),
    h as (select chunk_id, list_reduce(list_prepend(7::bigint, list_transform(string_split(w, ''), lambda c: ascii(c)::bigint)), lambda a, b: (a * 31 + b) % 100003) % {DIM} as place from w),
    n as (select chunk_id, place, count(*)::double as weight from h group by all)
    select chunk_id, place, weight from n union all select chunk_id, 0, 1.0 from t where chunk_id not in (select chunk_id from h)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest lines of items, in corpus order."""
    i = _items(spark, sf_dir).where("retrieval = 'retrieved'")
    return i.select("person", "item_id", "published_at", "external_id", (F.length("title") + F.length("external_id") + 3).cast("long").alias("size"))


def w8_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc_nulls_last("published_at"), F.asc("external_id")]
    return folds.passes(_lines(spark, sf_dir), "person", order, "size", BUDGET).select("person", "item_id", "pass")


W8 = f""", l as (select person, item_id, row_number() over (partition by person order by published_at desc nulls last, external_id) as r, length(title) + length(external_id) + 3 as n from items where retrieval = 'retrieved'),
    f as (select person, item_id, r, 0 as pass, n + 1 as used from l where r = 1
        union all select l.person, l.item_id, l.r, case when used + n > {BUDGET} then pass + 1 else pass end, case when used + n > {BUDGET} then n + 1 else used + n + 1 end from f join l on l.person = f.person and l.r = f.r + 1)
    select person, item_id, pass::bigint as pass from f"""


def t5_corpus_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).select("person", "item_id", "published_at", "external_id")
    return folds.numbered(i, "person", [F.desc_nulls_last("published_at"), F.asc("external_id")]).select("item_id", F.col("place").cast("long").alias("place"))


T5 = " select item_id, row_number() over (partition by person order by published_at desc nulls last, external_id) as place from items"


def s10_insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls that overlap, inserted one after the other, one of them twice; what is stored, and by which poll."""
    d = _table(spark, sf_dir, "documents").select("doc_id", "source", F.lit(0).cast("long").alias("poll"))
    path = sinks.new_folder(spark, "items")
    for poll, some in enumerate(("doc_id % 4 = 0", "doc_id % 3 <> 1", "doc_id % 3 <> 1", "doc_id >= 0")):
        sinks.insert_absent(d.where(some).withColumn("poll", F.lit(poll).cast("long")), path, ["doc_id"])
    return spark.read.parquet(path)


S10 = "select doc_id, source, (case when doc_id % 4 = 0 then 0 when doc_id % 3 <> 1 then 1 else 3 end)::bigint as poll from documents"


def s11_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all items stored, then those of every third replaced by one of their whole length."""
    c = _chunks(spark, sf_dir).select("item_id", "ordinal", "char_start", "char_end")
    path = sinks.new_folder(spark, "chunks")
    sinks.replace_by_key(c, path, "item_id", 8)
    whole = c.where("item_id % 3 = 0").groupBy("item_id").agg(F.lit(0).cast("long").alias("ordinal"), F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))
    sinks.replace_by_key(whole, path, "item_id", 8)
    return spark.read.parquet(path).groupBy("item_id").agg(F.count(F.lit(1)).alias("chunks"), F.max("char_end").alias("last"))


S11 = CHUNKED + " select doc_id as item_id, case when doc_id % 3 = 0 then 1 else count(*) end::bigint as chunks, max(e)::bigint as last from run group by doc_id"


def s12_current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions, of fewer and fewer languages; the documents of each language's current one."""
    d, root = _table(spark, sf_dir, "documents").select("doc_id", "lang"), sinks.new_folder(spark, "compiles")
    for version, some in enumerate(("doc_id >= 0", "lang <> 'en' and doc_id % 2 = 0", "lang = 'de' and doc_id % 5 = 0"), 1):
        sinks.publish(d.where(some), root, version, "lang")
    return sinks.current(spark, root, "lang").select("doc_id", "lang", F.col("version").cast("long").alias("version"))


S12 = """with v as (select doc_id, lang, 1 as version from documents union all select doc_id, lang, 2 from documents where lang <> 'en' and doc_id % 2 = 0 union all select doc_id, lang, 3 from documents where lang = 'de' and doc_id % 5 = 0)
    select doc_id, lang, version::bigint as version from v where version = (select max(version) from v w where w.lang = v.lang)"""


def i10_catalogue_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _items(spark, sf_dir).withColumn("audience", F.when(F.col("toxic") == 1, "paid").otherwise("everyone"))
    cols = lambda df, tag, title: df.select("item_id", F.concat(F.lit(f"{tag}/"), "external_id").alias("url"), "audience", title.alias("title"), F.col("published_at").alias("published_at"), F.col("retrieval").alias("state"), F.lit(tag).alias("lastmod"))
    old = cols(i.where("item_id % 3 <> 0"), "old", F.when(F.col("item_id") % 4 != 0, F.col("title")))
    new = cols(i.where("item_id % 5 <> 0").withColumn("retrieval", F.lit("pending")), "new", F.concat(F.lit("new "), "title"))
    return sinks.upserted(old, new, ["item_id"]).select("item_id", "url", "title", "state", "lastmod", F.date_format("published_at", "yyyy-MM-dd").alias("published"))


I10 = """ select item_id, case when item_id % 5 <> 0 then 'new/' else 'old/' end || external_id as url,
    case when item_id % 3 <> 0 and item_id % 4 <> 0 then title when item_id % 5 <> 0 then concat('new ', title) end as title,
    case when item_id % 3 <> 0 and retrieval <> 'pending' then retrieval when item_id % 5 <> 0 then 'pending' else retrieval end as state,
    case when item_id % 3 <> 0 and (retrieval <> 'pending' or item_id % 5 = 0) then 'old' else 'new' end as lastmod, strftime(published_at, '%Y-%m-%d') as published
    from items where item_id % 3 <> 0 or item_id % 5 <> 0"""


def _polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; its key is the user, its number that of the properties."""
    s = spark.readStream.schema(POLLS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = F.col("ts").cast("timestamp")
    return s.select(F.col("user_id").alias("key"), at.alias("ts"), F.col("event_id").alias("seq"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") == "error").alias("failed"), F.unix_seconds(at).alias("at_s"))


RUN = """with p as (select *, row_number() over (partition by user_id order by ts, event_id) as seq, json_extract_string(props, '$.k')::bigint as k, event_type = 'error' as bad from events),
    v as (select *, sum(case when bad then 0 else 1 end) over (partition by user_id order by seq rows unbounded preceding) as island from p),
    r as (select *, sum(case when bad then 1 else 0 end) over (partition by user_id, island order by seq rows unbounded preceding) as n from v)"""
STREAMS = {
    "i1_closed_days_stream": (streams.closed_days, "select user_id as key, strftime(ts, '%Y-%m-%d') as day, count(*) as posts from events where ts::date < (select max(ts)::date from events) group by all"),
    "i3_first_inserts_stream": (lambda s: streams.first_inserts(s.select("key", "k"), ["key", "k"]), "select distinct user_id as key, json_extract_string(props, '$.k')::bigint as k from events"),
    "i4_cursor_stream": (streams.cursors, RUN + " select user_id as key, event_id, max(k) over (partition by user_id order by seq rows unbounded preceding) as cursor_at from p"),
    "i5_gaps_stream": (streams.gaps, RUN + " select user_id as key, event_id, coalesce(k > max(k) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding), false) as reopened from p"),
    "i6_fault_ledger_stream": (streams.faults, RUN + ", f as (select *, floor(epoch(min(ts) filter (bad) over (partition by user_id, island)))::bigint as first_s, floor(epoch(ts))::bigint as last_s from r) select user_id as key, event_id, first_s, last_s, n::bigint as fails, last_s - first_s >= 86400 as escalated from f where bad"),
    "i7_silence_ledger_stream": (streams.silences, RUN + ", f as (select *, floor(epoch(min(ts) filter (bad) over (partition by user_id, island)))::bigint as first_s, floor(epoch(ts))::bigint as last_s from r) select user_id as key, event_id, n::bigint as attempts, last_s - first_s >= 86400 as outage from f where bad"),
    "i13_stuck_rebuilds_stream": (lambda s: streams.behind(s.withColumn("behind", F.col("k") % 2 == 0)), RUN.replace("event_type = 'error' as bad", "json_extract_string(props, '$.k')::bigint % 2 = 0 as bad") + " select user_id as key, event_id, n::bigint as cycles_behind, n >= 2 as fault from r where bad"),
    "i14_freshness_stream": (streams.freshest, RUN + ", s as (select *, floor(epoch(ts))::bigint as at_s from p), b as (select *, max(at_s) over (partition by user_id order by seq rows between unbounded preceding and 1 preceding) as before from s) select user_id as key, event_id, at_s as newest_s from b where before is null or at_s > before"),
    "i8_blocked_stream": (streams.blocks, RUN + " select user_id as key, event_id, 5::bigint as consecutive from r where bad and n = 5"),
    "i9_retry_budget_stream": (streams.retries, RUN + " select user_id as key, event_id, case when n >= 3 then 'failed' else 'pending' end as state from r where bad"),
}


def _stream(name: str, form):
    return lambda spark, sf_dir: streams.replay(form(_polls(spark, sf_dir)), name)


def i2_late_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days assembled from half of the events are stored, then days of all events come: (key, day, posts, late), the rows
    stored and those that came too late for a stored day."""
    day = [F.col("user_id").alias("key"), F.date_format("ts", "yyyy-MM-dd").alias("day")]
    e = _table(spark, sf_dir, "events")
    folder, path, late, state = (sinks.new_folder(spark, n) for n in ("day-source", "days", "late-days", "days-state"))
    for some in ("event_id % 2 = 0 and user_id % 3 <> 0", "true"):
        e.where(some).groupBy(*day).agg(F.count(F.lit(1)).alias("posts")).coalesce(1).write.mode("append").parquet(folder)
        streams.store_days(spark.readStream.schema("key long, day string, posts long").parquet(folder), path, late, state, ["key", "day"], ["posts"]).awaitTermination()
    return spark.read.parquet(path).withColumn("late", F.lit(False)).unionByName(spark.read.parquet(late).drop("batch").withColumn("late", F.lit(True)))


I2 = """with e as (select user_id as key, strftime(ts, '%Y-%m-%d') as day, count(*) as posts, count(*) filter (event_id % 2 = 0 and user_id % 3 <> 0) as early from events group by all)
    select key, day, case when early > 0 then early else posts end as posts, false as late from e union all select key, day, posts, true from e where early > 0"""

def w10_first_free_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.substring(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return folds.unique_slugs(_items(spark, sf_dir).select("person", "item_id", base.alias("base")), "person", "base", [F.asc("item_id")])


def _claimed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replies about each item of eight words or more, a sentence a row, some of their statements wrong; the items; and what is held."""
    i = register(spark, sf_dir, "items").table("items").where("words >= 8").withColumn("url", F.concat(F.lit("https://x.example/p/"), "external_id"))
    n, own = F.col("item_id"), F.concat(F.lit("http://www.x.example/p/"), F.col("external_id"), F.lit("/"))
    start = F.trim(F.substring(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), 1, 40))
    lines = [
        F.lit("**Record**"), F.concat(F.lit("**Title:** “"), F.when(n % 3 == 0, "Another title").otherwise(F.col("title")), F.lit("”.")), F.concat(F.lit("URL: "), F.when(n % 4 == 1, F.lit("https://x.example/p/elsewhere")).otherwise(own)),
        F.concat(F.lit("**Published at**: "), F.coalesce(F.date_format(F.date_add("published_at", F.when(n % 5 == 0, 1).otherwise(0)), "yyyy-MM-dd"), F.lit("unknown"))), F.concat(F.lit('Quote: "'), F.when(n % 7 == 0, "words that never stood there").otherwise(start), F.lit('"')),
        F.concat(F.lit("They say "), F.col("title")), F.lit("nothing like this was said before"),
    ]
    said = i.select("item_id", "person", F.col("url").alias("own_url"), F.posexplode(F.array(*lines)).alias("k", "text"))
    sentences = said.select((F.col("item_id") * 10 + F.col("k")).alias("sentence_id"), "person", "text", F.when(F.col("k") < 5, F.col("own_url")).when(F.col("k") == 6, "https://x.example/p/none").alias("claimed"))
    return sentences, i.select("person", "item_id", "url", "title", "published_at", F.col("text").alias("body")), i.where("item_id % 2 = 0").select("person", F.col("title").alias("statement"))


def j13_contains_both_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its SQL, beside the statements of ``text``, goes through pairs of items; this one through titles."""
    return contains.both_ways(register(spark, sf_dir, "items").table("items"))


def p5_keyword_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its SQL, beside the statements of ``measure``, joins titles and keywords on their grams; this one words and keywords."""
    i = register(spark, sf_dir, "items").table("items").where("retrieval <> 'retrieved' or item_id % 50 = 0")
    i = contains.written(i.select("item_id", "person", F.lower("title").alias("low"), (F.col("retrieval") != "retrieved").alias("unread")), "keyword-titles")
    kw = F.explode(F.split(F.regexp_replace("low", "[^a-z0-9 _-]", ""), " "))
    q = i.where("item_id % 50 = 0").select(F.col("item_id").alias("asked"), "person", kw.alias("kw")).where((F.length("kw") > 2) & ~F.col("kw").isin(find.STOP))
    return titles.holding_keywords(q, i.where("unread").select("item_id", "person", "low"))


def e5_verify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verify(*_claimed(spark, sf_dir))


def e5_source_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.faults(verify.verify(*_claimed(spark, sf_dir)))


E5 = r""", i as (select * from items where words >= 8), flat as (select person, item_id, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) as t from i),
    held as (select distinct s.item_id from flat s join flat h on h.person = s.person and h.item_id % 2 = 0 and length(h.t) >= 15 and (contains('they say ' || s.t, h.t) or contains(h.t, 'they say ' || s.t))),
    verdicts as (
        select item_id * 10 as sentence_id, person, item_id, 'header' as kind, 'sourced' as verdict from i union all select item_id * 10 + 1, person, item_id, 'title', case when item_id % 3 = 0 then 'unsourced' else 'sourced' end from i
        union all select item_id * 10 + 2, person, item_id, 'url', case when item_id % 4 = 1 then 'unsourced' else 'sourced' end from i
        union all select item_id * 10 + 3, person, item_id, 'published_at', case when published_at is null then 'never_claimed' when item_id % 5 = 0 then 'unsourced' else 'sourced' end from i
        union all select item_id * 10 + 4, person, item_id, 'quote', case when item_id % 7 = 0 then 'unsourced' else 'sourced' end from i
        union all select item_id * 10 + 5, person, null, 'sentence', case when item_id in (select item_id from held) then 'sourced' else 'never_claimed' end from i
        union all select item_id * 10 + 6, person, null, 'sentence', 'never_claimed' from i)"""

JOBS = {
    "a32_feed_survey": (a32_feed_survey, prelude() + f" select platform, count(*) filter (published is null or published >= '2024-03-01') as in_window, count(*) filter (published is null) as undated from ({S2}) e group by platform"),
    "j13_contains_both_ways": (j13_contains_both_ways, None), "p5_keyword_titles": (p5_keyword_titles, None), "w10_first_free_slugs": (w10_first_free_slugs, None), "e5_verify_sources": (e5_verify_sources, prelude() + E5 + " select * from verdicts"),
    "e5_source_faults": (e5_source_faults, prelude() + E5 + " select person, count(*) filter (verdict = 'sourced') as sourced, count(*) filter (verdict = 'unsourced') as unsourced, count(*) filter (verdict = 'never_claimed') as never_claimed, count(*) filter (verdict = 'unsourced') > 0 as fault from verdicts group by person"),
    "s2_feed_entries": (s2_feed_entries, prelude() + S2), "s3_sitemap_urls": (s3_sitemap_urls, S3), "s5_archive_items": (s5_archive_items, prelude() + S5), "s6_listing": (s6_listing, prelude() + S6), "s7_captions": (s7_captions, S7),
    "s8_own_posts": (s8_own_posts, S8), "s10_insert_if_absent": (s10_insert_if_absent, S10), "s11_replace_by_key": (s11_replace_by_key, S11), "s12_current_version": (s12_current_version, S12),
    "x1_html_text": (x1_html_text, X1), "x2_densest_container": (x2_densest_container, None), "x4_feed_body": (x4_feed_body, X4), "x6_published": (x6_published, X6), "x7_agreement": (x7_agreement, X7), "x8_longer_body": (x8_longer_body, X8),
    "a24_page_lines": (a24_page_lines, A24), "x3_page_bodies": (x3_page_bodies, X3), "x5_gates": (x5_gates, X5), "j15_shared_spans": (j15_shared_spans, None),
    "x10_chunks": (x10_chunks, X10), "j9_chunk_of_quote": (j9_chunk_of_quote, J9), "v5_embeddings": (v5_embeddings, V5), "w8_passes": (w8_passes, prelude() + W8), "t5_corpus_order": (t5_corpus_order, prelude() + T5),
    "i10_catalogue_upsert": (i10_catalogue_upsert, prelude() + I10), "i2_late_days": (i2_late_days, I2), **{k: (_stream(k, f), sql) for k, (f, sql) in STREAMS.items()},
}
QUERIES = {k: q for k, (q, _) in JOBS.items()}
ORACLES = {k: sql for k, (_, sql) in JOBS.items() if sql}
