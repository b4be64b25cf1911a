"""Lines that a site puts on its pages, taken out of what was read; and pages that say they are for members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The newest pages of a site that are compared; the least number of pages that shows a repetition.
NEWEST, TWICE = 20, 2
#: The class of an upgrade widget, and what a page for members says.
WIDGET, MEMBERS = "gh-post-upgrade-cta", r"(?i)this post is for [^.\n]{0,40}\b(?:subscribers?|members?)\b"


def lines(text: Column) -> Column:
    """Trimmed lines of a text that hold something."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def repeated_lines(pages: DataFrame, site: str = "host", page: str = "page_id", text: str = "text", newest: int = NEWEST) -> DataFrame:
    """(site, line, on_pages): lines that stand on at least half of a site's newest pages, and on two, each page once.

    ``pages`` has a row a page; a larger ``page`` is a newer one. A site of one page has none. A null text has no lines,
    a null site is one site. Pages are cut to the newest before their lines are spread.
    """
    rank = F.row_number().over(Window.partitionBy(site).orderBy(F.desc_nulls_last(page)))
    recent = pages.select(F.col(site).alias("s"), F.col(page).alias("p"), F.col(text).alias("t"), rank.alias("r")).where(F.col("r") <= newest)
    n = recent.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    on = recent.select("s", F.explode(F.array_distinct(lines(F.col("t")))).alias("line")).groupBy("s", "line").agg(F.count(F.lit(1)).alias("on_pages"))
    enough = F.col("on_pages") >= F.greatest(F.lit(TWICE), F.ceil(F.col("n") / 2))
    return on.alias("o").join(n.alias("n"), F.col("o.s").eqNullSafe(F.col("n.s"))).where(enough).select(F.col("o.s").alias(site), "line", "on_pages")


def without_repeated(pages: DataFrame, repeated: DataFrame, site: str = "host", page: str = "page_id", text: str = "text") -> DataFrame:
    """(site, page, text) of each page without the lines that its site repeats, in their order; an empty text where none is left."""
    every = pages.select(F.col(site).alias("s"), F.col(page).alias("p"), F.posexplode_outer(lines(F.col(text))).alias("at", "line"))
    gone = repeated.select(F.col(site).alias("gs"), F.col("line").alias("gl"))
    kept = every.join(gone, F.col("s").eqNullSafe(F.col("gs")) & (F.col("line") == F.col("gl")), "left")
    held = F.when(F.col("gl").isNull() & F.col("line").isNotNull(), F.struct("at", "line"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(held)), lambda x: x["line"]), "\n")
    return kept.groupBy("s", "p").agg(whole.alias("text")).select(F.col("s").alias(site), F.col("p").alias(page), "text")


def gate(markup: Column, text: Column) -> Column:
    """What says that a page is for members: its widget, on markup without scripts and styles, or the words of its text; else null."""
    shown = F.regexp_replace(markup, r"(?is)<(script|style)(?:\s[^>]*)?>.*?</\1\s*>", "")
    return F.when(shown.contains(WIDGET), WIDGET).when(text.rlike(MEMBERS), "members-cta-copy")
