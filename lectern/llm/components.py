"""Connected components of an edge table by alternating stars; no edge or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .util import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, root): root is the smallest id reachable, for every id of ``edges(a, b)``.

    Large stars hang a node's larger neighbours on its smallest one, small stars its smaller ones; in the end each
    component is one star. The number of rounds grows with the logarithm of the longest path. Each round is written to
    the shared folder, as is the result, and the round before it deleted; edges that are stars already take no round.
    Null ends and loops are dropped; no edges give no rows.
    """
    e = stage(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
        unsettled = ends.groupBy("id").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 0 and n > 1")
        if not unsettled.count():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, old = stage(small, "stars"), e
        discard(old)
    out = stage(e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("id"), "root").union(e.select("v", F.col("v").alias("root")).distinct()), "roots")
    discard(e)
    return out
