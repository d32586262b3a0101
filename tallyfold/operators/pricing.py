"""Applying prices at query time."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_model

#: A price table of more rows than this is joined as Spark sees fit, instead of broadcast.
BROADCAST_ROWS = 10_000


#: Costs are exact decimals of 12 places until a report shows them, so that no order of addition changes a sum.
MONEY = "decimal(38,12)"


def _at(tokens: Column, rate: str) -> Column:
    """Dollars of so many tokens at a rate in dollars per million; rates have six places."""
    # widths are such that no product or sum exceeds 38 digits, where Spark would give up places
    micro = tokens.cast("decimal(19,0)") * F.col(f"__p.{rate}").cast("decimal(11,6)")
    return (micro.cast("decimal(31,6)") * F.lit(Decimal("0.000001")).cast("decimal(6,6)")).cast("decimal(32,12)")


def cost() -> Column:
    """Dollars of the five priced token counts at the joined rates."""
    parts = [_at(F.col(c), r) for c, r in (("input_tokens", "input"), ("output_tokens", "output"), ("cache_read", "cache_read"), ("cache_write5m", "cache_write_5m"), ("cache_write1h", "cache_write_1h"))]
    return reduce(lambda a, b: a + b, parts).cast(MONEY)


def uncached_cost() -> Column:
    """The same work with every cached token billed as fresh input."""
    fresh = F.col("input_tokens") + F.col("cache_read") + F.col("cache_write5m") + F.col("cache_write1h")
    return (_at(fresh, "input") + _at(F.col("output_tokens"), "output")).cast(MONEY)


def dollars(money: Column | str) -> Column:
    """A cost as the nearest double, for a report."""
    return (F.col(money) if isinstance(money, str) else money).cast(MONEY).cast("double")


def less(a: Column | str, b: Column | str) -> Column:
    """a - b of two costs, to the last place."""
    one = lambda x: (F.col(x) if isinstance(x, str) else x).cast("decimal(36,12)")
    return (one(a) - one(b)).cast(MONEY)


def price(usage: DataFrame, prices: DataFrame, model_col: str = "model", uncached: bool = False) -> DataFrame:
    """usage with priced, cost_usd (MONEY, 0 if unpriced) and, on request, uncached_cost_usd. No rows are lost or added.

    The price table is a dimension of some tens of rows; it is broadcast after its rows are counted (limit BROADCAST_ROWS).
    """
    rates = prices.groupBy("id").agg(*[F.max(c).alias(c) for c in ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h")]).select("id", F.struct("input", "output", "cache_read", "cache_write_5m", "cache_write_1h").alias("__p"))
    if prices.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    joined = usage.join(rates, normalize_model(model_col) == F.col("id"), "left")
    nothing = F.lit(0).cast(MONEY)
    out = joined.withColumn("priced", F.col("__p").isNotNull()).withColumn("cost_usd", F.coalesce(cost(), nothing))
    if uncached:
        out = out.withColumn("uncached_cost_usd", F.coalesce(uncached_cost(), nothing))
    return out.drop("id", "__p")
