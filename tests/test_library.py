"""The library's functions on literal cases, against brute force, and in several batches."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import chunking, embedding, html
from lectern.operators import find, folds, jobs, vectors, verify
from lectern.plans.bindings import register
from lectern.sources import documents as read, sinks
from lectern.streaming import streams

SF = "/root/testdata/sf0.001"


def test_chunks_hold_every_word(spark):
    rng = random.Random(3)
    texts = ["", None, " \n ", "x" * 4000, "one", *["\n".join(" ".join("w" * rng.randint(1, 30) for _ in range(rng.randint(0, 200))) for _ in range(rng.randint(1, 12))) for _ in range(60)]]
    rows = chunking.chunk_items(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).collect()
    for k, text in enumerate(texts):
        own = sorted((r for r in rows if r.item_id == k), key=lambda r: r.ordinal)
        assert [r.ordinal for r in own] == list(range(len(own)))
        assert all(r.text == text[r.char_start : r.char_end] and 0 < len(r.text) <= 1500 and r.start_ms is None for r in own)
        held = set().union(*(range(r.char_start, r.char_end) for r in own))
        assert all(i in held for i, c in enumerate(text or "") if not c.isspace())
        assert all(a.char_start < b.char_start and a.char_end <= b.char_end for a, b in zip(own, own[1:]))


def test_caption_chunks_and_places(spark):
    lines = [(0, "hello there"), (900, "general"), (1500, "hello there")]
    rows = [(1, "hello there general hello there", lines, 4.0), (2, "other words", lines, None)]
    items = spark.createDataFrame(rows, "item_id long, text string, lines array<struct<at:long,text:string>>, seconds double")
    got = {r.item_id: r for r in chunking.chunk_items(items, captions="lines", duration="seconds").collect()}
    assert (got[1].start_ms, got[1].end_ms, got[2].start_ms) == (0, 4000, None)
    chunks = spark.createDataFrame([(1, 0, 0, 1500), (1, 1, 1400, 2900), (1, 2, 2950, 4000)], "item_id long, ordinal long, char_start long, char_end long")
    places = spark.createDataFrame([(1, 0), (1, 1450), (1, 1500), (1, 2920), (1, 3999), (7, 3)], "item_id long, at long")
    assert {(r.item_id, r.at): r.ordinal for r in chunking.chunk_of(places, chunks).collect()} == {(1, 0): 0, (1, 1450): 0, (1, 1500): 1, (1, 2920): None, (1, 3999): 2, (7, 3): None}


def test_pages_to_text():
    page = '<p>Tom &amp; Ann</p><script>var t="</p>";</script><div class="x subscription-widget-wrap"><div>Join</div> us</div><p>one<br/>two&nbsp; &#233;&#x41;</p><STYLE>p{}</STYLE>'
    assert html.plain(html.cleared(page)) == "Tom & Ann\n\none\ntwo éA"
    assert html.plain(html.cleared("<div class='subscription-widget'>kept</div><script>never closed")) == "kept"
    prose = "word " * 100
    text, name = html.densest(f'<nav>Home</nav><main><div class="post body"><p>{prose}</p></div><aside>more</aside></main><footer>Us</footer>')
    assert (text, name) == (prose.strip(), "div.post")
    assert html.densest("<p>short</p>")[1] == "page" and html.densest("") == ("", "page")


def test_documents_to_rows(spark):
    feed = """<rss><channel><title>All</title><item><title><![CDATA[A & B]]></title><link>https://x.example/p/one?u=1</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>
        <item><title>No id</title></item><entry><title>C &lt;d&gt; &#169;</title><link rel="alternate" href="https://x.example/p/tw%20o"/><updated>2024-03-06T00:00:00Z</updated></entry></channel></rss>"""
    rows = read.feed_entries(spark.createDataFrame([(1, "substack", feed), (2, "substack", None), (3, "blog", "no feed")], "k int, platform string, body string")).orderBy("position").collect()
    assert [(r.external_id, r.title, r.published_at.day) for r in rows] == [("one", "A & B", 5), ("tw o", "C <d> ©", 6)]
    urls = read.sitemap_urls(spark.createDataFrame([("<urlset><url><loc>https://a/?x=1&amp;y=2</loc><lastmod>2024-01-02</lastmod></url><url><loc>mailto:x</loc></url><url><lastmod>2024</lastmod></url></urlset>",)], "body string")).collect()
    assert [(r.loc, r.lastmod.day) for r in urls] == [("https://a/?x=1&y=2", 2)]
    archive = '[{"slug":"a","post_date":"2024-05-01T00:00:00Z","audience":"everyone"},{"title":"no name"},{"slug":"b","audience":" "},{"slug":"c","post_date":"2023-01-01"},{"slug":"d","post_date":"2024-05-01"}]'
    table = spark.createDataFrame([(archive, "x.example", datetime.datetime(2024, 1, 1)), ("{", "y", None), (None, "z", None)], "body string, handle string, floor timestamp")
    assert [(r.external_id, r.audience) for r in read.archive_items(table).collect()] == [("a", "everyone"), ("b", "unknown")]
    codes = spark.createDataFrame([("1:02:03",), ("4:05",), ("LIVE",), ("",), (None,)], "c string").select(read.seconds(F.col("c")).alias("s")).collect()
    assert [r.s for r in codes] == [3723, 245, None, None, None]
    track = spark.createDataFrame([('{"events":[{"tStartMs":0,"segs":[{"utf8":"a \\n"},{"utf8":" b"}]},{"tStartMs":9},{"tStartMs":15,"segs":[{"utf8":"c"}]}]}',), ('{"events":[]}',)], "body string")
    assert [(r.text, [x.at for x in r.lines]) for r in read.caption_lines(track).collect()] == [("a b c", [0, 15])]


def test_published_statements(spark):
    pages = {
        '<meta name="x" content="1"><META property=\'article:published_time\' content="2024-03-04T00:00:00Z"><time datetime="2020-01-01">': "article:published_time",
        '<meta property="article:published_time" content="soon"><script>{"datePublished": "2024-03-04"}</script>': "json-ld", "<time class='a' datetime='2024-03-04T08:00:00+08:00'>": "time", "<time>2024</time>": None,
    }
    rows = spark.createDataFrame([(k,) for k in pages], "h string").select("h", read.published(F.col("h")).alias("d")).collect()
    assert {r.h: r.d and r.d.found_in for r in rows} == pages and all(r.d is None or (r.d.at.month, r.d.at.day) == (3, 4) for r in rows)


def test_sinks_may_run_twice(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (1, "w"), (2, "y"), (None, "z")], "k long, v string")
    path = f"file://{tmp_path}/t"
    assert sorted(map(tuple, sinks.insert_absent(a, path, ["k"], ["v"]).collect())) == [(1, "w"), (2, "y")]
    assert sinks.insert_absent(a, path, ["k"], ["v"]).count() == 0 and spark.read.parquet(path).count() == 2
    chunks = spark.createDataFrame([(k, i) for k in range(20) for i in range(3)], "item long, i int")
    for _ in range(2):
        sinks.replace_by_key(chunks, f"{path}-c", "item", 4)
    sinks.replace_by_key(chunks.where("item = 3 and i = 0"), f"{path}-c", "item", 4)
    assert {r["item"]: r["count"] for r in spark.read.parquet(f"{path}-c").groupBy("item").count().collect()} == {k: 1 if k == 3 else 3 for k in range(20)}
    people = spark.createDataFrame([("a", 1), ("b", 1)], "person string, n int")
    sinks.publish(people, f"{path}-v", 1, "person")
    sinks.publish(people.where("person = 'a'").withColumn("n", F.lit(2)), f"{path}-v", 2, "person")
    people.withColumn("n", F.lit(9)).write.parquet(f"{path}-v/version=3")  # a version that was never pointed to
    assert sorted((r.person, r.n) for r in sinks.current(spark, f"{path}-v", "person").collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("k", [None, 3])
def test_scores_against_all_pairs(spark, monkeypatch, k):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    rng, day = np.random.default_rng(1), datetime.date(2024, 1, 1)
    v = rng.normal(size=(40, 5)).tolist()
    v[7] = [0.0] * 5
    dates = [None if i % 9 == 0 else day + datetime.timedelta(i) for i in range(40)]
    chunks = [(i, i % 3, i // 2, i % 2, v[i] if i != 8 else None, dates[i]) for i in range(40)]
    questions = [(i, i % 3 if i != 5 else None, v[i], day + datetime.timedelta(10) if i == 1 else None, day + datetime.timedelta(30) if i == 1 else None) for i in range(7)]
    got = vectors.score(spark.createDataFrame(questions, "q_id long, person int, q_vec array<double>, since date, until date"), spark.createDataFrame(chunks, "chunk_id long, person int, item long, ordinal int, embedding array<double>, published_at date"), k)
    want = []
    for q, p, qv, since, until in questions:
        own = []
        for c, cp, item, _, cv, d in chunks:
            if p is not None and cp == p and c != q and ((since is None and until is None) or (d is not None and since <= d <= until)):
                norm = np.linalg.norm(qv) * np.linalg.norm(cv or [0.0])
                own.append((q, c, item, float(np.floor(np.dot(qv, cv) / norm * 1e4 + 0.5) / 1e4) if norm else 0.0))
        want += sorted(own, key=lambda r: (-r[3], r[2], r[1]))[:k]
    assert sorted((r.q_id, r.chunk_id, r["item"], r.cos) for r in got.collect()) == sorted(want)


def test_background_is_the_mean_cosine(spark):
    rng = np.random.default_rng(2)
    v, labels = rng.normal(size=(50, 4)), rng.integers(0, 3, 50)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    vectors_ = spark.createDataFrame([(i, v[i].tolist(), int(labels[i])) for i in range(50)], "vec_id long, embedding array<double>, label int")
    statements = spark.createDataFrame([(i, int(labels[i]), v[i].tolist()) for i in range(9)], "position long, person int, s_vec array<double>")
    for others in (True, False):
        got = {r.position: r.background for r in vectors.background(statements, vectors_, others).collect()}
        for i in range(9):
            keep = labels != labels[i] if others else labels >= 0
            assert abs(got[i] - (unit[keep] @ unit[i]).mean()) < 6e-4


def test_numbered_and_passes(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc") if k % 7 else None, rng.choice([None, 1, 2, 3]), rng.randint(0, 40)) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, key string, day int, size long").repartition(5)
    order = [F.desc_nulls_last("day"), F.asc("id")]
    want = {}
    for key in {r[1] for r in rows}:
        for n, r in enumerate(sorted((r for r in rows if r[1] == key), key=lambda r: (-(r[2] or 0), r[0])), 1):
            want[r[0]] = n
    assert {r.id: r.place for r in folds.numbered(df, "key", order).collect()} == want
    got = {r.id: r["pass"] for r in folds.passes(df, "key", order, "size", 60).collect()}
    for key in {r[1] for r in rows}:
        used = k = 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: want[r[0]]):
            if used and used + r[3] > 60:
                used, k = 0, k + 1
            used += r[3] + 1
            assert got[r[0]] == k


@pytest.mark.parametrize("part, budget", [(1, 6), (1, 9), (50, 20), (1 << 16, 15)])
def test_passes_over_many_parts(spark, part, budget):
    """One key over many tasks, another over one, names that clash, nulls, and lines longer than the budget."""
    rng = random.Random(part + budget)
    rows = [(None if k % 50 == 1 else "a" if k % 10 else "b", k, None if k % 13 == 0 else rng.choice([0, 1, 2, 3, budget, budget + 5]), "x", "y") for k in range(600)]
    got = folds.passes(spark.createDataFrame(rows, "part string, at int, size int, __k string, __place string").repartition(3), "part", ["at"], "size", budget, part=part).collect()
    want = []
    for key in ("a", "b", None):
        used, n = None, 0
        for r in rows:
            if r[0] == key:
                size = r[2] or 0
                if used is not None and used + size > budget:
                    used, n = 0, n + 1
                used = (used or 0) + size + 1
                want.append((*r, n))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(want, key=lambda r: r[1])


def test_names_in_numbered_rows(spark):
    """The literal case: columns of the caller that are called as the helper's own."""
    rows = spark.createDataFrame([("a", k, "x", "y") for k in (3, 1, 2)], "key string, v int, __n string, __part string")
    assert [tuple(r) for r in folds.numbered(rows, "key", ["v"]).orderBy("v").collect()] == [("a", 1, "x", "y", 1), ("a", 2, "x", "y", 2), ("a", 3, "x", "y", 3)]


def test_embedding_backlog(spark):
    texts = spark.createDataFrame([(1, "Some words here, some"), (2, None), (3, "a b")], "chunk_id long, text string")
    first = embedding.embed_missing(texts.where("chunk_id = 1"), None, "m", embedding.hashed_words(8), 8)
    rest = embedding.embed_missing(texts, first, "m", embedding.hashed_words(8), 8)
    assert {r.chunk_id: sum(r.embedding) for r in rest.collect()} == {2: 1.0, 3: 1.0} and sum(first.first().embedding) == 4.0
    assert embedding.embed_missing(texts, first, "other", embedding.hashed_words(8), 8).count() == 3
    with pytest.raises(Exception, match="finite"):
        embedding.embed_missing(texts, None, "m", lambda t: np.full((len(t), 8), np.nan), 8).collect()


def test_streams_in_several_batches(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for low in (0, 300, 600):  # three files in order of time, a batch each
        events.where(f"event_id >= {low} and event_id < {low + (300 if low < 600 else 10**9)}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    one = jobs._polls

    def split(form, name):
        s = spark.readStream.schema(jobs.POLLS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
        at = F.col("ts").cast("timestamp")
        polls = s.select(F.col("user_id").alias("key"), at.alias("ts"), F.col("event_id").alias("seq"), "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("event_type") == "error").alias("failed"), F.unix_seconds(at).alias("at_s"))
        return sorted(map(str, streams.replay(form(polls), name).collect()))

    for name in ("i4_cursor_stream", "i6_fault_ledger_stream", "i1_closed_days_stream"):
        form = jobs.STREAMS[name][0]
        assert split(form, name) == sorted(map(str, streams.replay(form(one(spark, SF)), name).collect()))


def test_floors_and_fits(spark):
    rows = spark.createDataFrame([(0.6, False, None), (0.4, False, None), (None, False, None), (0.9, True, None), (0.9, True, 0.3)], "m double, moved boolean, o double")
    assert [r.f for r in rows.select(find.effective_floor(F.col("m"), F.col("moved"), F.col("o")).alias("f")).collect()] == [0.6, 0.52, 0.55, 0.55, 0.3]
    rows = spark.createDataFrame([(0.5, 0.1, 0.4), (0.3, 0.1, 0.4), (0.1, 0.1, 0.4), (0.5, 0.1, 0.0), (0.5, None, 0.4), (None, 0.1, 0.4)], "s double, c double, n double")
    assert [r.f for r in rows.select(find.fit(F.col("s"), F.col("c"), F.col("n")).alias("f")).collect()] == ["close", "partial", "distant", "ungraded", "ungraded", "ungraded"]
    assert spark.createDataFrame([("What about the Über-cool GPU's?",)], "t string").select(find.keywords(F.col("t")).alias("k")).first().k == ["ber-cool", "gpu's"]


def test_queries_leave_the_callers_views_alone(spark):
    spark.range(3).createOrReplaceTempView("documents")
    own = register(spark, SF, "items")
    assert spark.table("documents").count() == 3 and own.table("items").count() == 200
    spark.catalog.dropTempView("documents")


def test_record_lines(spark):
    lines = {
        "**Record**": ("header", ""), "**Title**: On it": ("title", "On it"), "*url:* x.example/a": ("url", "x.example/a"), "Published: 2024-01-02": ("published_at", "2024-01-02"), "published at: soon": None,
        "Title: On it": None, "Quote: “well”": ("quote", "“well”"), "Link: see below": None, "date: on 2024-01-02 at noon": ("published_at", "on 2024-01-02 at noon"), "They said: no": None, "": None,
    }
    rows = spark.createDataFrame([(k,) for k in lines], "t string").select("t", verify.record_field(F.col("t")).alias("f")).collect()
    assert {r.t: r.f and tuple(r.f) for r in rows} == lines
    assert spark.createDataFrame([("HTTPS://www.A.example/x/.",)], "u string").select(verify.comparable(F.col("u")).alias("c")).first().c == "a.example/x"


def test_verdicts(spark):
    items = spark.createDataFrame([("p", 1, "https://a.example/x", "One title", datetime.date(2024, 1, 2), "It was  said here."), ("p", 2, "https://a.example/y", None, None, None)], "person string, item_id long, url string, title string, published_at date, body string")
    held = spark.createDataFrame([("p", "Nothing grows in the dark"), ("p", "short")], "person string, statement string")
    asked = [
        ("it was said here", "a.example/x/", "sourced"), ("it was never said", "a.example/x", "unsourced"), ("anything", "a.example/y", "unsourced"), ("Nothing grows in the dark, I think", "a.example/y", "sourced"), ("grows in the dark", None, "sourced"),
        ("a short one", None, "never_claimed"), ("it was said here", "Two title", "never_claimed"), ("it was said here", "One title", "sourced"), ("**Title**: x", "a.example/y", "never_claimed"), (None, "a.example/x", "unsourced"),
    ]
    rows = spark.createDataFrame([(k, "p", t, c) for k, (t, c, _) in enumerate(asked)], "sentence_id long, person string, text string, claimed string")
    assert {r.sentence_id: r.verdict for r in verify.verify(rows, items, held).collect()} == {k: v for k, (_, _, v) in enumerate(asked)}


def test_unique_slugs(spark):
    rng = random.Random(6)
    rows = [(k, rng.choice("pq"), rng.choice(["a", "b", "a-2", "a-2-2", "b-3", "c"])) for k in range(80)]
    got = {r.id: r.slug for r in folds.unique_slugs(spark.createDataFrame(rows, "id long, person string, base string").repartition(4), "person", "base", [F.asc("id")]).collect()}
    taken = set()
    for k, person, base in rows:
        n, slug = 1, base
        while (person, slug) in taken:
            n += 1
            slug = f"{base}-{n}"
        taken.add((person, slug))
        assert got[k] == slug


def test_voice_counts(spark):
    from lectern.operators.measure import MOVED
    from lectern.plans.dialect import Spark

    texts = ["I think so. Maybe, maybe not; improbably, I'm not sure. I dont think ökind of maybeé", "First, you need to. Finally, it's not about speed, it's cost. You're my, my friend; we were yours", "To be fair, which is wild. That said, the wrong question", ""]
    own = spark.newSession()
    own.createDataFrame([(k, "p", len(t.split()), t, "retrieved") for k, t in enumerate(texts)], "item_id long, person string, words long, text string, retrieval string").createOrReplaceTempView("items")
    got = {r.move: r.n for r in own.sql(MOVED(Spark) + " select move, sum(hits) as n from moved group by move").collect()}
    assert got == {"hedging": 8, "direct-address": 1, "enumeration": 2, "wry-aside": 2, "concession-pivot": 1, "reframe": 2, "second": 3, "first": 5, "plural": 2}
