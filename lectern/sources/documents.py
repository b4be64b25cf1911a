"""Fetched documents to rows: feeds, sitemaps, archives, listings, captions and author feeds, by built-in functions alone.

Each function takes a table of bodies, a row for each document, with columns of the caller's that stay beside what is
found. A body that is null or of another kind gives no row. Rows are read each, so repeated bodies give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: References of XML to signs, the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    """Without CDATA marks, decimal and named references as their signs, trimmed."""
    text = F.regexp_replace(text, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    parts = F.transform(F.split(text, r"(?=&#[0-9]{1,7};)"), lambda x: F.when(x.rlike(r"^&#[0-9]{1,7};"), F.concat(F.chr(F.regexp_extract(x, r"^&#([0-9]+);", 1).cast("long")), F.regexp_replace(x, r"^&#[0-9]+;", ""))).otherwise(x))
    text = F.when(text.contains("&#"), F.array_join(parts, "")).otherwise(text)
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blocks(body: Column, *names: str) -> Column:
    """What stands inside each element of the names, in order of the names; nested ones of the same name are not followed."""
    return F.concat(*[F.coalesce(F.regexp_extract_all(body, F.lit(rf"(?is)<{n}(?:\s[^>]*)?>(.*?)</{n}\s*>"), F.lit(1)), F.array().cast("array<string>")) for n in names])


def first(body: Column, name: str) -> Column:
    """The decoded text of the first element of a name; null if there is none."""
    return decoded(F.try_element_at(blocks(body, name), F.lit(1)))


def web(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?:"), url)


def slug_of(url: Column) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(url, r"/p/([^/?#]+)", 1), F.lit("")))


def moment(text: Column) -> Column:
    """A time from ISO 8601 or RFC 822 spelling, in UTC; null if it is neither."""
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")))


def feed_entries(feeds: DataFrame, body: str = "body", platform: str = "platform") -> DataFrame:
    """RSS and Atom: (other columns, platform, position, external_id, url, title, published_at), a row for each entry that can be named.

    The id is the video's on "youtube", the link on "blog", and elsewhere the part after /p/ of the guid or the link; the
    url is the link, or what the id or a guid that is a link gives.
    """
    e = F.col("entry")
    href = F.nullif(F.regexp_extract(e, r"(?is)<link\b[^>]*\bhref\s*=\s*\"([^\"]+)\"", 1), F.lit(""))
    link, guid = F.coalesce(web(first(e, "link")), decoded(href)), first(e, "guid")
    kind = F.col(platform)
    ident = F.when(kind == "youtube", F.coalesce(first(e, "yt:videoId"), first(e, "videoId"))).when(kind == "blog", web(F.coalesce(link, guid))).otherwise(slug_of(F.coalesce(guid, link)))
    rows = feeds.select(*[c for c in feeds.columns if c != body], F.posexplode(blocks(F.col(body), "item", "entry")).alias("position", "entry"))
    rows = rows.withColumn("external_id", F.nullif(ident, F.lit(""))).withColumn("url", F.coalesce(link, F.when(kind == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), "external_id")).when(kind == "blog", F.col("external_id")).otherwise(web(guid))))
    rows = rows.withColumn("title", first(e, "title")).withColumn("published_at", moment(F.coalesce(first(e, "pubDate"), first(e, "published"), first(e, "updated"))))
    return rows.where("external_id is not null and url is not null").drop("entry")


def sitemap_urls(maps: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, loc, lastmod) of each <url> whose <loc> is a web address."""
    rows = maps.select(*[c for c in maps.columns if c != body], F.explode(blocks(F.col(body), "url")).alias("entry"))
    return rows.withColumn("loc", web(first(F.col("entry"), "loc"))).withColumn("lastmod", moment(first(F.col("entry"), "lastmod"))).drop("entry").where("loc is not null")


ARCHIVE = "array<struct<slug:string,canonical_url:string,title:string,post_date:string,audience:string>>"


def archive_items(archives: DataFrame, body: str = "body", handle: str = "handle", floor: str = "floor") -> DataFrame:
    """Archive records, newest first: (other columns, external_id, url, title, published_at, audience) down to the first one before ``floor``.

    The walk of a document ends at the first dated record before the floor, as the rest are older; records without slug
    and address are passed over. Audience: blank is "unknown", "everyone" stays, anything else is "paid".
    """
    rows = archives.select(*[c for c in archives.columns if c != body], F.from_json(body, ARCHIVE).alias("records"))
    dated = F.transform("records", lambda r: F.struct(F.coalesce(r["slug"], slug_of(r["canonical_url"])).alias("external_id"), r["canonical_url"].alias("given"), r["title"].alias("title"), moment(r["post_date"]).alias("published_at"), r["audience"].alias("said")))
    old = F.array_position(F.transform(dated, lambda r: F.coalesce(r["published_at"] < F.col(floor), F.lit(False)) & r["external_id"].isNotNull()), True)
    kept = F.when(old > 0, F.slice(dated, F.lit(1), (old - 1).cast("int"))).otherwise(dated)
    rows = rows.select(*[c for c in rows.columns if c != "records"], F.explode(kept).alias("r")).where("r.external_id is not null")
    said = F.trim("r.said")
    audience = F.when(F.coalesce(said, F.lit("")) == "", "unknown").when(said == "everyone", "everyone").otherwise("paid")
    return rows.select(*[c for c in rows.columns if c != "r"], "r.external_id", F.coalesce("r.given", F.concat(F.lit("https://"), handle, F.lit("/p/"), "r.external_id")).alias("url"), "r.title", "r.published_at", audience.alias("audience"))


_TEXT = "struct<content:string>"
_LOCKUP = f"struct<contentId:string,metadata:struct<lockupMetadataViewModel:struct<title:{_TEXT},metadata:struct<contentMetadataViewModel:struct<metadataRows:array<struct<metadataParts:array<struct<text:{_TEXT}>>>>>>>>,contentImage:struct<thumbnailViewModel:struct<overlays:array<struct<thumbnailBottomOverlayViewModel:struct<badges:array<struct<thumbnailBadgeViewModel:struct<text:string>>>>>>>>>"
_GRID = f"array<struct<richItemRenderer:struct<content:struct<lockupViewModel:{_LOCKUP}>>>>"
LISTING = f"struct<onResponseReceivedActions:array<struct<appendContinuationItemsAction:struct<continuationItems:{_GRID}>>>,contents:struct<twoColumnBrowseResultsRenderer:struct<tabs:array<struct<tabRenderer:struct<content:struct<richGridRenderer:struct<contents:{_GRID}>>>>>>>>"


def seconds(code: Column) -> Column:
    """h:mm:ss, m:ss or ss as seconds; null for anything else."""
    parts = F.split(code, ":")
    return F.when(F.trim(code).rlike(r"^[0-9]{1,9}(?::[0-9]{1,2}){0,2}$"), F.aggregate(F.transform(parts, lambda x: F.trim(x).cast("long")), F.lit(0).cast("long"), lambda s, x: s * 60 + x))


def listing_videos(listings: DataFrame, body: str = "body") -> DataFrame:
    """A listing's grid, or that of its continuation: (other columns, position, video_id, title, duration_s, rough_age)."""
    rows = listings.select(*[c for c in listings.columns if c != body], F.from_json(body, LISTING).alias("d"))
    more = F.flatten(F.transform("d.onResponseReceivedActions", lambda a: F.coalesce(a["appendContinuationItemsAction"]["continuationItems"], F.array().cast(_GRID))))
    grids = F.filter(F.transform("d.contents.twoColumnBrowseResultsRenderer.tabs", lambda t: t["tabRenderer"]["content"]["richGridRenderer"]["contents"]), lambda g: g.isNotNull())
    items = F.coalesce(F.when(F.size(more) > 0, more), F.try_element_at(grids, F.lit(1)))
    rows = rows.select(*[c for c in rows.columns if c != "d"], F.posexplode(items).alias("position", "i")).withColumn("v", F.col("i.richItemRenderer.content.lockupViewModel")).where("v.contentId is not null and v.contentId <> ''")
    meta = F.col("v.metadata.lockupMetadataViewModel")
    parts = F.flatten(F.transform(meta["metadata"]["contentMetadataViewModel"]["metadataRows"], lambda r: F.coalesce(r["metadataParts"], F.array().cast(f"array<struct<text:{_TEXT}>>"))))
    ages = F.filter(F.transform(parts, lambda p: p["text"]["content"]), lambda t: t.rlike(r"\bago\b"))
    badges = F.flatten(F.transform("v.contentImage.thumbnailViewModel.overlays", lambda o: F.coalesce(o["thumbnailBottomOverlayViewModel"]["badges"], F.array().cast("array<struct<thumbnailBadgeViewModel:struct<text:string>>>"))))
    lasts = F.filter(F.transform(badges, lambda b: seconds(b["thumbnailBadgeViewModel"]["text"])), lambda s: s.isNotNull())
    return rows.select(*[c for c in rows.columns if c not in ("i", "v")], F.col("v.contentId").alias("video_id"), meta["title"]["content"].alias("title"), F.try_element_at(lasts, F.lit(1)).alias("duration_s"), F.try_element_at(ages, F.lit(1)).alias("rough_age"))


CAPTIONS = "struct<events:array<struct<tStartMs:long,segs:array<struct<utf8:string>>>>>"


def caption_lines(tracks: DataFrame, body: str = "body") -> DataFrame:
    """(other columns, lines array<struct<at,text>>, text): events with words, white space collapsed; a track without words gives no row."""
    rows = tracks.select(*[c for c in tracks.columns if c != body], F.from_json(body, CAPTIONS)["events"].alias("events"))
    words = lambda e: F.trim(F.regexp_replace(F.array_join(F.transform(e["segs"], lambda s: F.coalesce(s["utf8"], F.lit(""))), ""), r"(?U)\s+", " "))
    lines = F.filter(F.transform("events", lambda e: F.struct(F.coalesce(e["tStartMs"], F.lit(0).cast("long")).alias("at"), F.coalesce(words(e), F.lit("")).alias("text"))), lambda x: x["text"] != "")
    return rows.withColumn("lines", lines).drop("events").where("size(lines) > 0").withColumn("text", F.array_join(F.transform("lines", lambda x: x["text"]), " "))


_AUTHOR = "struct<author:struct<did:string>>"
AUTHOR_FEED = f"struct<feed:array<struct<reason:string,reply:struct<parent:{_AUTHOR}>,post:struct<uri:string,author:struct<did:string>,indexedAt:string,record:struct<text:string,createdAt:string>>>>>"


def own_posts(feeds: DataFrame, body: str = "body", did: str = "did") -> DataFrame:
    """An author's own posts: (other columns, position, uri, rkey, posted_at, text), without reposts, posts of others,
    replies to others, empty and undated posts."""
    rows = feeds.select(*[c for c in feeds.columns if c != body], F.posexplode(F.from_json(body, AUTHOR_FEED)["feed"]).alias("position", "e"))
    rows = rows.withColumn("text", F.trim("e.post.record.text")).withColumn("posted_at", moment(F.coalesce("e.post.record.createdAt", "e.post.indexedAt")))
    mine = F.col("e.reason").isNull() & (F.col("e.post.uri") != "") & (F.col("e.post.author.did") == F.col(did)) & F.coalesce(F.col("e.reply.parent.author.did") == F.col(did), F.lit(True))
    return rows.where(mine & (F.col("text") != "") & F.col("posted_at").isNotNull()).select(*[c for c in rows.columns if c not in ("e", "text", "posted_at")], F.col("e.post.uri").alias("uri"), F.regexp_extract("e.post.uri", r"([^/]*)$", 1).alias("rkey"), "posted_at", "text")


def feed_body(entry: Column) -> Column:
    """struct(element, whole, html): the fullest body element of an entry by what it is, decoded; null if there is none."""
    order = ("content:encoded", "content", "description", "summary")
    found = [F.try_element_at(blocks(entry, n), F.lit(1)) for n in order]
    return F.coalesce(*[F.when(x.isNotNull(), F.struct(F.lit(n).alias("element"), F.lit(n.startswith("content")).alias("whole"), decoded(x).alias("html"))) for n, x in zip(order, found)])


def published(html: Column) -> Column:
    """struct(at, found_in): the first of a page's own statements that is a date: meta, JSON-LD, a time element."""
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    meta = F.filter(metas, lambda m: F.lower(F.regexp_extract(m, r"(?i)\b(?:property|name)\s*=\s*[\"']([^\"']*)[\"']", 1)) == "article:published_time")
    stated = F.filter(F.transform(meta, lambda m: F.regexp_extract(m, r"(?i)\bcontent\s*=\s*[\"']([^\"']*)[\"']", 1)), lambda v: v != "")
    said = {"article:published_time": decoded(F.try_element_at(stated, F.lit(1))), "json-ld": F.regexp_extract(html, r"(?i)\"datePublished\"\s*:\s*\"([^\"]+)\"", 1), "time": F.regexp_extract(html, r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"']", 1)}
    return F.coalesce(*[F.when(moment(v).isNotNull(), F.struct(moment(v).alias("at"), F.lit(k).alias("found_in"))) for k, v in said.items()])


def agreement(pages: DataFrame, key: str, page: Column, feed: Column) -> DataFrame:
    """(key, share) of rows with a unique ``key``: the share of a page's words, lower-cased, that occur in the feed's text; 0
    for a page without words. Words meet by (key, word), each side's once, so that a long text takes time in proportion."""
    words = lambda c: F.explode(F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda x: x != "")).alias("word")
    own = pages.select(F.col(key).alias("k"), words(page)).groupBy("k", "word").agg(F.count(F.lit(1)).alias("n"))
    fed = pages.select(F.col(key).alias("k"), words(feed)).distinct().withColumn("fed", F.lit(True))
    found = own.join(fed, ["k", "word"], "left").groupBy("k").agg((F.coalesce(F.sum(F.when(F.col("fed"), F.col("n"))), F.lit(0)) / F.sum("n")).alias("share"))
    return pages.select(key).join(found, F.col(key) == F.col("k"), "left").select(key, F.coalesce("share", F.lit(0.0)).alias("share"))
