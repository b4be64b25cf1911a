"""Floors and fit scales measured for all people at once: their own probes against probes from elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import vectors
from .find import UNMEASURED_FLOOR, rounded

#: Own probes wanted and needed; how far above the highest foreign probe the measured level lies.
WANTED, NEEDED, ANCHOR = 12, 4, 0.25


def evenly(rows: DataFrame, key: str, order: str, wanted: int, exact: bool) -> DataFrame:
    """At most ``wanted`` rows a key, evenly spaced by ``order``: every n-th, or, if ``exact``, those at i * n / wanted."""
    own = Window.partitionBy(key)
    at = rows.withColumn("__i", F.row_number().over(own.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(own))
    if exact:  # the row at place p is taken if some i has floor(i * n / wanted) = p
        taken = F.expr(f"__n <= {wanted} or (((__i * {wanted} + __n - 1) div __n) * __n) div {wanted} = __i and (__i * {wanted} + __n - 1) div __n < {wanted}")
    else:
        taken = F.expr(f"__i % greatest(__n div {wanted}, 1) = 0 and __i div greatest(__n div {wanted}, 1) < {wanted}")
    return at.where(taken).drop("__i", "__n")


def level(tops: DataFrame, fallback: float | None) -> DataFrame:
    """(person, level, span, separation, in_low, out_high) of ``tops`` (person, inside, top), the best score of each probe.

    Where all own probes score above all foreign ones, the level lies between them; otherwise it is ``fallback``.
    """
    low, high, n = F.min(F.when(F.col("inside"), F.col("top"))), F.max(F.when(~F.col("inside"), F.col("top"))), F.count_if(F.col("inside"))
    m = tops.groupBy("person").agg(low.alias("in_low"), high.alias("out_high"), n.alias("n_in"))
    state = F.when((F.col("n_in") < NEEDED) | F.col("out_high").isNull(), "not_measurable").when(F.col("out_high") >= F.col("in_low"), "overlapping").otherwise("separated")
    m = m.withColumn("separation", state)
    apart, gap = F.col("separation") == "separated", F.col("in_low") - F.col("out_high")
    measured = F.when(apart, rounded(F.col("out_high") + gap * ANCHOR)).otherwise(F.lit(fallback).cast("double"))
    seen = F.col("separation") != "not_measurable"
    return m.select("person", measured.alias("level"), F.when(apart, rounded(gap)).alias("span"), "separation", *[F.when(seen, rounded(F.col(c))).alias(c) for c in ("in_low", "out_high")])


def floors(chunks: DataFrame, positions: DataFrame, foreign: DataFrame) -> DataFrame:
    """``level`` of each person's own statements, and of ``foreign`` (q_id, person, q_vec), against the chunks of the person."""
    own = evenly(positions, "person", "position", WANTED, exact=False).select(F.col("position").alias("q_id"), "person", F.col("s_vec").alias("q_vec"))
    tops = [vectors.score(q.select("q_id", "person", "q_vec"), chunks, k=1, own=True).withColumnRenamed("cos", "top").select("person", F.lit(inside).alias("inside"), "top") for q, inside in ((own, True), (foreign, False))]
    return level(tops[0].unionByName(tops[1]), UNMEASURED_FLOOR)


def scales(quotes: DataFrame, positions: DataFrame, backgrounds: DataFrame, foreign: DataFrame) -> DataFrame:
    """``level`` of each person's own quotes (q_id, person, q_vec), and of foreign probes, against the statements of the
    person, each score less its statement's background; no level where they do not separate."""
    targets = positions.select(F.col("position").alias("chunk_id"), "person", F.col("position").alias("item"), F.lit(0).alias("ordinal"), F.col("s_vec").alias("embedding"))
    less = backgrounds.select(F.col("position").alias("chunk_id"), "background")
    tops = []
    for q, inside in ((evenly(quotes, "person", "q_id", WANTED, exact=True), True), (foreign, False)):
        scored = vectors.score(q.select("q_id", "person", "q_vec"), targets, own=True).join(less, "chunk_id", "left").withColumn("score", rounded(F.col("cos") - F.coalesce("background", F.lit(0.0))))
        tops.append(scored.groupBy("q_id", "person").agg(F.max("score").alias("top")).select("person", F.lit(inside).alias("inside"), "top"))
    return level(tops[0].unionByName(tops[1]), None)
