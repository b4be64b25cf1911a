"""Positions that answer a table of questions, with their evidence, and what is said where nothing answers.

All answers stand on one table of hits, the nearest chunks of each question, which is written once; the rest are windows
and joins over it. A question's gate is its best hit against the floor of its person. Where the nearest item over the floor
carries no position, the person has read about it without holding one, and no position answers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.sinks import new_folder
from . import vectors

#: Chunks over the floor and items that are candidates; chunks of the field; passages and positions given;
#: citations of a position; the nearest named where nothing answers; weights of a position's statement and of its items.
HITS, ITEMS, FIELD, PASSAGES, GIVEN_PASSAGES, CITED, NEAREST = 480, 60, 400, 60, 5, 4, 3
DEFAULT_LIMIT, MOST_LIMIT = 10, 50
STATEMENT, ITEM = 0.6, 0.4
LEAST_FLOOR, UNMEASURED_FLOOR = 0.52, 0.55
CLOSE, PARTIAL = 0.66, 0.33
#: Words that are no keywords.
STOP = """the and for are but not you all can had her was one our out has have been what with that this from your they its about
which their would could should them than then some these into over after also other more such how why who when where did does just""".split()
RUNGS = ("silence", "uncovered", "withheld", "missed", "outranked", "grounded")


def effective_floor(measured: Column, moved: Column, override: Column) -> Column:
    """The override, if there is one; the unmeasured floor, if the measure has changed since; else what was measured, within bounds."""
    return F.coalesce(override, F.when(moved, UNMEASURED_FLOOR).otherwise(F.greatest(F.coalesce(measured, F.lit(UNMEASURED_FLOOR)), F.lit(LEAST_FLOOR))))


def fit(score: Column, cut: Column, span: Column) -> Column:
    height = score - cut
    return F.when(height.isNull() | span.isNull() | F.isnan(span) | (span <= 0), "ungraded").when(height >= span * CLOSE, "close").when(height >= span * PARTIAL, "partial").otherwise("distant")


def keywords(text: Column) -> Column:
    """Lower-cased words of three characters or more that are no stop words, in order."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s'_-]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP))


def _copied(rows: DataFrame) -> DataFrame:
    return rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1).cast("long"))


def _repeated(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` as often as their ``copies`` say, at most ``most`` times."""
    n = F.col("copies") if most is None else F.least("copies", F.lit(most))
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long")))).drop("copies")


def rounded(c: Column, k: float = 1e4) -> Column:
    return F.floor(c * k + 0.5) / k


@dataclass(frozen=True)
class Find:
    """``questions`` (q_id, person, q_vec, query, since, until, wanted); ``chunks`` (chunk_id, person, item, ordinal,
    embedding, published_at); ``items`` (item, person, title, published_at, retrieval); ``positions`` (position, person,
    slug, s_vec); ``backgrounds`` (position, background); ``citations`` (position, item); ``relations`` (p_from, p_to,
    relation); ``lines`` (line, item); ``floors`` (person, floor, cut, span).

    ``copies`` of a question or chunk, where given, says for how many rows that are alike it stands; ranks count them all, but
    each is searched once. Rows of a question are alike.

    Nulls: a question without a person or a vector's person without chunks is silent; undated items come last. Ties are
    broken by item, chunk, slug. Empty tables give empty answers.
    """

    questions: DataFrame
    chunks: DataFrame
    items: DataFrame
    positions: DataFrame
    backgrounds: DataFrame
    citations: DataFrame
    relations: DataFrame
    lines: DataFrame
    floors: DataFrame

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.questions.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    @cached_property
    def asked(self) -> DataFrame:
        """A row for each question, with its copies."""
        names = ["person", "q_vec", "query", "since", "until", "wanted"]
        q = _copied(self.questions).groupBy("q_id").agg(F.min(F.struct(*names)).alias("q"), F.sum("copies").alias("copies"))
        return q.select("q_id", "q.*", "copies")

    @cached_property
    def hits(self) -> DataFrame:
        """(q_id, chunk_id, item, cos, floor, r, copies): the nearest chunks of each question, in order, with the first of the
        ranks that they take, one for each copy of the question and of the chunk; written once."""
        chunks = _copied(self.chunks).withColumn("ordinal", F.col("copies")).drop("copies")  # the search hands it on
        near = vectors.score(self.asked.drop("copies"), chunks, k=HITS).join(self.asked.select("q_id", F.col("copies").alias("times")), "q_id")
        near = near.withColumn("copies", F.col("ordinal") * F.col("times")).drop("r", "ordinal", "times")
        before = Window.partitionBy("q_id").orderBy(F.desc("cos"), "item", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("r", F.coalesce(F.sum("copies").over(before), F.lit(0)) + 1).where(F.col("r") <= HITS)
        near = near.join(F.broadcast(self.floors.select(F.col("person").cast("long").alias("person"), "floor")), "person")  # a row a person
        return self._written(near.withColumn("copies", self._within(HITS)), "hits")

    @staticmethod
    def _within(most: int) -> Column:
        """How many of a hit's ranks are among the first ``most``."""
        return F.least("copies", F.lit(most + 1) - F.col("r"))

    @cached_property
    def facts(self) -> DataFrame:
        """(q_id, person, floor, cut, span, bound, top, median, selected, uncovered): a row a question; ``uncovered`` is the
        nearest item over the floor, where no position cites it."""
        field = self.hits.where(F.col("r") <= FIELD).groupBy("q_id").agg(F.max("cos").alias("top"), F.expr(f"percentile(cos, 0.5, least(copies, {FIELD + 1} - r))").alias("median"))
        best = self.hits.where("r = 1 and cos >= floor").select("q_id", "item").join(self.citations.select("item").distinct(), "item", "left_anti")
        q = self.asked.select("q_id", "person", F.greatest(F.lit(1), F.least(F.lit(MOST_LIMIT), F.coalesce("wanted", F.lit(DEFAULT_LIMIT)))).alias("bound")).join(self.floors, "person", "left")
        out = q.join(field, "q_id", "left").join(best.select("q_id", F.col("item").alias("uncovered")), "q_id", "left")
        return self._written(out.withColumn("selected", F.coalesce(F.col("top") >= F.col("floor"), F.lit(False))), "facts")

    @cached_property
    def candidates(self) -> DataFrame:
        """(q_id, item, best, item_rank): the nearest items over the floor, by their nearest chunk."""
        found = self.hits.where("cos >= floor").groupBy("q_id", "item").agg(F.max("cos").alias("best"))
        return found.withColumn("item_rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("best"), "item"))).where(F.col("item_rank") <= ITEMS)

    @cached_property
    def statements(self) -> DataFrame:
        """(q_id, position, slug, scos, copies): each question's cosine to the statements of its person."""
        as_chunks = self.positions.select(F.col("position").alias("chunk_id"), "person", F.col("position").alias("item"), F.lit(0).alias("ordinal"), F.col("s_vec").alias("embedding"))
        scored = vectors.score(self.asked.select("q_id", "person", "q_vec"), as_chunks, own=True).join(self.asked.select("q_id", "copies"), "q_id")
        return scored.select("q_id", F.col("chunk_id").alias("position"), F.col("cos").alias("scos"), "copies").join(self.positions.select("position", "slug"), "position")

    @cached_property
    def matched(self) -> DataFrame:
        """(q_id, position, slug, best, score, blend, item_count, fit, place, bound): all positions that answer, in order."""
        open_ = self.facts.where("selected and uncovered is null").select("q_id", "cut", "span", "bound")
        held = self.candidates.join(open_, "q_id").join(self.citations, "item").groupBy("q_id", "cut", "span", "bound", "position").agg(F.max("best").alias("best"))
        score = rounded(F.col("scos") - F.coalesce("background", F.lit(0.0)), 1e3)
        rows = held.join(_repeated(self.statements), ["q_id", "position"]).join(self.backgrounds, "position", "left").join(self.citations.groupBy("position").agg(F.count(F.lit(1)).alias("item_count")), "position")
        rows = rows.withColumn("score", score).withColumn("blend", rounded(STATEMENT * F.col("score") + ITEM * F.col("best"))).withColumn("fit", fit(F.col("score"), F.col("cut"), F.col("span")))
        order = [F.desc(F.coalesce("blend", F.lit(-1.0))), F.desc("best"), F.desc("item_count"), F.asc("slug")]
        return self._written(rows.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).select("q_id", "position", "slug", "best", "score", "blend", "item_count", "fit", "place", "bound"), "matched")

    @property
    def shown(self) -> DataFrame:
        return self.matched.where("place <= bound")

    def answers(self) -> DataFrame:
        more = F.greatest(F.count(F.lit(1)).over(Window.partitionBy("q_id")) - F.col("bound"), F.lit(0))
        return self.matched.withColumn("more", more.cast("long")).where("place <= bound").select("q_id", "slug", "score", "blend", "fit", "item_count", "place", "more")

    def cited(self) -> DataFrame:
        """(q_id, place, item, r, more): the first citations of each position shown, newest first."""
        dated = self.citations.join(self.items.select("item", "published_at"), "item", "left")
        first = dated.withColumn("r", F.row_number().over(Window.partitionBy("position").orderBy(F.desc_nulls_last("published_at"), "item"))).where(F.col("r") <= CITED)
        n = dated.groupBy("position").agg(F.greatest(F.count(F.lit(1)) - CITED, F.lit(0)).alias("more"))
        return self.shown.select("q_id", "place", "position").join(first, "position").join(n, "position").select("q_id", "place", "item", "r", "more")

    def related(self) -> DataFrame:
        """(q_id, slug, other, relation, direction, current): relations of the positions shown, read from both ends; a
        position that was revised is not current."""
        slugs = self.positions.select(F.col("position").alias("end"), F.col("slug").alias("other"))
        ends = self.relations.select(F.col("p_from").alias("position"), F.col("p_to").alias("end"), "relation", F.lit("to").alias("direction")).unionByName(self.relations.select(F.col("p_to").alias("position"), F.col("p_from").alias("end"), "relation", F.lit("from").alias("direction")))
        revised = self.relations.where("relation = 'revised'").select(F.col("p_from").alias("position")).distinct().withColumn("revised", F.lit(True))
        return self.shown.select("q_id", "position", "slug").join(ends, "position").join(slugs, "end").join(revised, "position", "left").select("q_id", "slug", "other", "relation", "direction", F.col("revised").isNull().alias("current"))

    def riding(self) -> DataFrame:
        """(q_id, line, n, r): lines that run through the positions shown, at most as many as these are."""
        n = self.shown.groupBy("q_id").agg(F.count(F.lit(1)).alias("most"))
        rows = self.shown.select("q_id", "position").join(self.citations, "position").join(self.lines, "item").groupBy("q_id", "line").agg(F.countDistinct("position").alias("n"))
        return rows.withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("n"), "line"))).join(n, "q_id").where("r <= most").select("q_id", "line", "n", "r")

    def passages(self) -> DataFrame:
        """(q_id, chunk_id, r, more): the nearest passages, for selected questions that no position answers."""
        silent = self.facts.where("selected").select("q_id").join(self.matched.select("q_id").distinct(), "q_id", "left_anti")
        found = self.hits.where(f"cos >= floor and r <= {PASSAGES}").join(silent, "q_id")
        n = F.sum(self._within(PASSAGES)).over(Window.partitionBy("q_id"))
        given = found.withColumn("more", F.greatest(n - GIVEN_PASSAGES, F.lit(0))).where(F.col("r") <= GIVEN_PASSAGES).withColumn("copies", self._within(GIVEN_PASSAGES))
        return given.select("q_id", "chunk_id", F.explode(F.expr("sequence(r, r + copies - 1)")).alias("r"), "more")

    def nearest(self) -> DataFrame:
        """(q_id, slug, r): positions that come nearest, where none answers."""
        silent = self.facts.where("uncovered is not null or not selected").select("q_id")
        return _repeated(self.statements, NEAREST).join(silent, "q_id").withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("scos"), "slug"))).where(F.col("r") <= NEAREST).select("q_id", "slug", "r")

    def nothing_matched(self) -> DataFrame:
        """(q_id, nearest_similarity, floor): questions that are neither answered, nor covered by passages, nor read without a position."""
        return self.facts.where("not selected and uncovered is null").select("q_id", rounded(F.col("top"), 1e3).alias("nearest_similarity"), "floor")

    def read_without_position(self) -> DataFrame:
        return self.facts.where("uncovered is not null").select("q_id", F.col("uncovered").alias("item")).join(self.items.select("item", "title", "published_at"), "item", "left").select("q_id", "item", "title", "published_at")

    def unread(self) -> DataFrame:
        """(q_id, item, reason, r): the newest items not read whose title holds a keyword of a question that nothing matched.

        A keyword's first three characters stand somewhere in such a title, so both meet on them within a person.
        """
        asked = self.nothing_matched().select("q_id").join(self.asked.select("q_id", "person", F.col("copies").alias("times"), F.explode(F.array_distinct(keywords(F.col("query")))).alias("kw")), "q_id")
        asked = asked.withColumn("gram", F.substring("kw", 1, 3))
        grams = self.items.where("retrieval <> 'retrieved' and title is not null and length(title) >= 3").groupBy("item", "person", "title", "published_at", "retrieval").agg(F.count(F.lit(1)).alias("copies")).withColumn("low", F.lower("title"))
        grams = grams.select("item", "person", "published_at", "retrieval", "low", "copies", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("low") - 2), lambda i: F.substring(F.col("low"), i, F.lit(3))))).alias("gram"))
        found = asked.join(grams, ["person", "gram"]).where(F.col("low").contains(F.col("kw"))).select("q_id", "item", "published_at", F.col("retrieval").alias("reason"), "low", (F.col("copies") * F.col("times")).alias("copies")).distinct()
        return _repeated(found, NEAREST).withColumn("r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc_nulls_last("published_at"), "item"))).where(F.col("r") <= NEAREST).select("q_id", "item", "reason", "r")

    def rungs(self, golden: DataFrame) -> DataFrame:
        """(q_id, person, gate, item_rank, cites, reached, grounded, rung, lost) of ``golden`` (q_id, item, and copies where given): how far the search came to the item a question was made of.

        Grounded: the first position cites the item among the citations given; reached: any shown does.
        """
        key = ["q_id", "item"]
        golden = _copied(golden).groupBy(*key).agg(F.sum("copies").alias("copies"))
        rank = self.candidates.join(golden.select(*key), key).select(*key, "item_rank")
        cites = golden.select("item").distinct().join(self.citations, "item", "left").groupBy("item").agg(F.countDistinct("position").alias("cites"))
        on = self.cited().join(golden.select(*key), key).groupBy(*key).agg(F.min("place").alias("first"))
        shown = self.shown.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_shown"))
        f = golden.join(self.facts.select("q_id", "person", "selected"), "q_id").join(rank, key, "left").join(cites, "item", "left").join(on, key, "left").join(shown, "q_id", "left")
        f = _repeated(f.withColumn("cites", F.coalesce("cites", F.lit(0))))  # an item that is null has none
        silence = ~F.col("selected")
        rung = F.when(silence, "silence").when(F.col("cites") == 0, "uncovered").when(F.col("item_rank").isNull(), "withheld").when(F.col("first").isNull(), "missed").when(F.col("first") == 1, "grounded").otherwise("outranked")
        lost = F.when(silence, "gate").when(F.col("item_rank").isNull(), "candidate").when(F.col("cites") == 0, "no position").when(F.col("first").isNull() & F.col("n_shown").isNull(), "no answer").when(F.col("first").isNull(), "not shown").when(F.col("first") > 1, "ranked below")
        return f.select("q_id", "person", F.col("selected").alias("gate"), F.coalesce("item_rank", F.lit(0)).cast("long").alias("item_rank"), F.col("cites").cast("long").alias("cites"), F.col("first").isNotNull().alias("reached"), F.coalesce(F.col("first") == 1, F.lit(False)).alias("grounded"), rung.alias("rung"), lost.alias("lost"))


def funnel(rungs: DataFrame) -> DataFrame:
    """(person, asked, gate, candidate, cited, reached, grounded): each step counts those that passed all before it; a null person is the fleet."""
    gate = F.col("gate")
    candidate = gate & (F.col("item_rank") > 0)
    cited = candidate & (F.col("cites") > 0)
    reached = cited & F.col("reached")
    steps = {"gate": gate, "candidate": candidate, "cited": cited, "reached": reached, "grounded": reached & F.col("grounded")}
    return rungs.rollup("person").agg(F.count(F.lit(1)).alias("asked"), *[F.count_if(c).alias(k) for k, c in steps.items()])


def scorecard(rungs: DataFrame) -> DataFrame:
    """(person, a count for each rung, asked, grounded_rate, bar): bar is pass from 70 % grounded on; a null person is the fleet."""
    counts = [F.count_if(F.col("rung") == r).alias(r) for r in RUNGS]
    card = rungs.rollup("person").agg(*counts, F.count(F.lit(1)).alias("asked"))
    return card.withColumn("grounded_rate", rounded(F.col("grounded") / F.col("asked"))).withColumn("bar", F.when(F.col("asked") == 0, "not_measured").when(10 * F.col("grounded") >= 7 * F.col("asked"), "pass").otherwise("fail"))
