"""Cost for each pull request."""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.fold import fold
from ..operators.pricing import dollars, price
from ..schema import USAGE

SPLIT = [c for c in USAGE if c != "think_tokens"]

#: Parts of a token that shares are counted in: the least common multiple of 1 to 40, so that an even split among up to 40 pull
#: requests is exact, and one among n more is short by less than n parts.
PARTS = lcm(*range(1, 41))


def session_model_totals(folded: DataFrame) -> DataFrame:
    """Usage by session and model: made before any join with pull requests. Sessions unknown are left out."""
    return folded.filter(F.col("session_id").isNotNull()).groupBy("session_id", "model").agg(F.count(F.lit(1)).alias("requests"), *[F.sum(c).alias(c) for c in SPLIT])


def session_pull_requests(records: DataFrame) -> DataFrame:
    """session_id, pr_repo, pr_number: each once."""
    return records.filter(F.col("pr_repo").isNotNull() & F.col("session_id").isNotNull()).select("session_id", "pr_repo", "pr_number").distinct()


def link_weights(records: DataFrame) -> DataFrame:
    """session_id, pr_count: how many pull requests share a session."""
    return session_pull_requests(records).groupBy("session_id").agg(F.count(F.lit(1)).alias("pr_count"))


def shared_usage(records: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """Usage by session and model, each row with links, the session's pull requests: array<struct<pr_repo, pr_number>>, and first, on one row of each session.

    The archive is read twice: for the fold (or its stored copy is, if folding names it), and for the links, which are few. Usage is summed by session before it meets
    them; the mark and the join need one and the same partitioning.
    """
    links = session_pull_requests(records).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("pr_repo", "pr_number"))).alias("links"))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("model")) == 1  # a session has a few models
    return session_model_totals(fold(records if folding is None else folding)).withColumn("first", first).join(links, "session_id")


def _split(usage: DataFrame) -> DataFrame:
    """By pull request and model: counts, and each token column's whole tokens and parts of a token as exact sums."""
    each = usage.withColumn("pr_count", F.size("links").cast("long")).withColumn("link", F.explode("links"))
    whole = [F.sum(F.expr(f"{c} div pr_count")).alias(f"{c}_whole") for c in SPLIT]
    parts = [F.sum(F.expr(f"{c} % pr_count * ({PARTS} div pr_count)").cast("decimal(20,0)")).alias(f"{c}_parts") for c in SPLIT]
    return each.groupBy("link.pr_repo", "link.pr_number", F.coalesce("model", F.lit("unknown")).alias("model")).agg(
        F.sum("requests").alias("requests"), F.count(F.lit(1)).alias("sessions"), F.sum(F.when(F.col("pr_count") > 1, F.col("requests")).otherwise(0)).alias("shared_requests"),
        F.sum("output_tokens").alias("output_total"), F.count_if("first").alias("all_sessions"), F.count_if(F.col("first") & (F.col("pr_count") > 1)).alias("shared_sessions"), *whole, *parts,
    )


def delivery_totals(records: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """By pull request and model: requests, sessions, shared_requests, output_total, and even shares of tokens.

    Shares are sums of integers, divided once at the end: they do not depend on how rows are dealt.
    """
    shares = [(F.col(f"{c}_whole").cast("double") + F.col(f"{c}_parts").cast("double") / F.lit(float(PARTS))).alias(f"{c}_share") for c in SPLIT]
    return _split(shared_usage(records, folding)).select("pr_repo", "pr_number", "model", "requests", "sessions", "shared_requests", "output_total", *shares)


def pull_requests(records: DataFrame, prices: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """One row for each pull request, the dearest first (ties by repo and number).

    Shares are cut to whole tokens for each model before pricing. sessions and shared_sessions count distinct sessions over
    all models; shared_requests counts requests of shared sessions. Unpriced models cost 0 and clear all_priced.
    """
    tokens = [(F.col(f"{c}_whole") + F.floor(F.col(f"{c}_parts") / F.lit(PARTS))).cast("long").alias(c) for c in SPLIT]
    whole = _split(shared_usage(records, folding)).select("pr_repo", "pr_number", "model", "requests", "shared_requests", "output_total", "all_sessions", "shared_sessions", *tokens)
    out = price(whole, prices).groupBy("pr_repo", "pr_number").agg(
        F.sum("requests").alias("requests"), F.sum("shared_requests").alias("shared_requests"), F.sum("output_total").alias("output_tokens"), dollars(F.sum("cost_usd")).alias("cost_usd"), F.bool_and("priced").alias("all_priced"),
        F.sum("all_sessions").alias("sessions"), F.sum("shared_sessions").alias("shared_sessions"),
    )
    return out.orderBy(F.desc("cost_usd"), "pr_repo", "pr_number")


def attribution(records: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """attributed, total, share: requests of the fold in sessions that opened a pull request."""
    shipped = records.filter(F.col("pr_repo").isNotNull() & F.col("session_id").isNotNull()).select("session_id").distinct().withColumn("__s", F.lit(True))
    return fold(records if folding is None else folding).groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).join(shipped, "session_id", "left").agg(
        F.coalesce(F.sum(F.when(F.col("__s"), F.col("n"))), F.lit(0)).alias("attributed"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    ).withColumn("share", F.coalesce(F.try_divide(F.col("attributed").cast("double"), F.col("total").cast("double")), F.lit(0.0)))
