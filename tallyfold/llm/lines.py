"""Operator 9: line deduplication by site-relative frequency. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: A line on more than this part of a host's pages is boilerplate ...
RATIO = 0.05
#: ... if it is on so many of its pages at least.
MIN_PAGES = 5
#: Hosts' lists of boilerplate lines are sent to all executors up to so many lines in all; beyond, they are joined by shuffle.
BROADCAST_LINES = 200_000


def boilerplate(df: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, h1, h2, n_pages, n_host: lines (by 128-bit hash) on more than `ratio` of a host's pages, and on min_pages at least.

    A page counts once for each distinct line with a character other than a blank. Pages are counted before the
    shuffle by host and line, so a hot host or line moves a row for each task.
    """
    pages = df.select(F.col(host_col).cast("string").alias("host"), F.array_distinct(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n", -1), lambda x: F.trim(x) != "")).alias("lines"))
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    each = pages.select("host", F.explode("lines").alias("line")).select("host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")).groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    return each.join(total, each["host"].eqNullSafe(total["host"])).drop(total["host"]).filter(F.col("n_pages") > F.lit(float(ratio)) * F.col("n_host"))


def dedup_lines(df: DataFrame, host_col: str, text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, out_cols: list[str] | None = None, count_cols: bool = True) -> DataFrame:
    """out_cols (all but text by default), text, n_lines, n_dropped: every page without its host's boilerplate lines.

    A line is what lies between newlines, compared exactly; blank lines are never dropped. A null host is a host
    of its own. A null text stays null, with no lines; a text of only boilerplate becomes empty but stays a row.
    Ratio and least pages are compared strictly and inclusively: n_pages > ratio * n_host, n_pages >= min_pages.

    A host's list is at most its mean number of lines over `ratio`. Lists are broadcast while their counted size
    is within BROADCAST_LINES, and joined by shuffle beyond; a hot host's pages are split by adaptive execution.
    """
    found = common.keep(boilerplate(df, host_col, text_col, ratio, min_pages), "boilerplate")
    lists = found.groupBy(F.concat(F.lit("h"), F.col("host")).alias("host")).agg(F.collect_list(F.struct("h1", "h2")).alias("__drop"))
    lists = lists.withColumn("host", F.coalesce("host", F.lit("")))
    if found.count() <= BROADCAST_LINES:
        lists = F.broadcast(lists)
    keep_cols = [c for c in (out_cols if out_cols is not None else df.columns) if c != text_col]
    rows = df.select(*[F.col(f"`{c}`") for c in keep_cols], F.col(text_col).cast("string").alias("__text"), F.coalesce(F.concat(F.lit("h"), F.col(host_col).cast("string")), F.lit("")).alias("__host"))
    joined = rows.join(lists.withColumnRenamed("host", "__list_host"), F.col("__host") == F.col("__list_host"), "left")
    stays = lambda x: ~F.array_contains(F.col("__drop"), F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"))) | (F.trim(x) == "")
    split = F.split(F.col("__text"), "\n", -1)
    left = F.when(F.col("__drop").isNull(), split).otherwise(F.filter(split, stays))
    out = joined.select(*[F.col(f"`{c}`") for c in keep_cols], F.col("__text"), split.alias("__split"), left.alias("__left"))
    counts = [F.coalesce(F.size("__split"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__split") - F.size("__left"), F.lit(0)).cast("long").alias("n_dropped")]
    text = F.when(F.col("__text").isNotNull(), F.array_join("__left", "\n")).alias(text_col)
    return out.select(*[F.col(f"`{c}`") for c in keep_cols], text, *([F.when(F.col("__text").isNull(), 0).otherwise(c).cast("long").alias(n) for c, n in zip(counts, ("n_lines", "n_dropped"))] if count_cols else []))
