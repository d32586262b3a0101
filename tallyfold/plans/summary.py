"""The summary report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import fold, model_totals
from ..operators.pricing import dollars, less, price


def summary_models(records: DataFrame, prices: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """model, requests, tokens, priced, cost_usd, uncached_cost_usd; the most output first, ties by model. folding: the stored copy of records, if there is one."""
    out = price(model_totals(fold(records if folding is None else folding)), prices, uncached=True)
    return out.withColumns({c: dollars(c) for c in ("cost_usd", "uncached_cost_usd")}).orderBy(F.desc("output_tokens"), "model")


def line_counts(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("lines"), F.count("request_id").alias("assistant_lines"))


def summary_totals(records: DataFrame, prices: DataFrame, folding: DataFrame | None = None) -> DataFrame:
    """One row of totals: costs over priced models only; the hit rate over all; unpriced models by output."""
    models = price(model_totals(fold(records if folding is None else folding)), prices, uncached=True)
    fresh = F.sum(F.col("input_tokens") + F.col("cache_write5m") + F.col("cache_write1h"))
    unpriced = F.array_sort(F.collect_list(F.when(~F.col("priced"), F.struct((-F.col("output_tokens")).alias("o"), F.col("model").alias("m")))))
    totals = models.agg(
        F.coalesce(F.sum("requests"), F.lit(0)).alias("requests"), F.coalesce(F.sum("cost_usd"), F.lit(0)).alias("total_cost_usd"), F.coalesce(F.sum("uncached_cost_usd"), F.lit(0)).alias("total_uncached_cost_usd"),
        F.coalesce(F.try_divide(F.sum("cache_read").cast("double"), (F.sum("cache_read") + fresh).cast("double")), F.lit(0.0)).alias("cache_hit_rate"),
        F.transform(unpriced, lambda x: x.m).alias("unpriced_models"),
    )
    return (
        totals.crossJoin(line_counts(records))  # one row each
        .withColumn("cache_savings_usd", dollars(less("total_uncached_cost_usd", "total_cost_usd")))
        .withColumns({c: dollars(c) for c in ("total_cost_usd", "total_uncached_cost_usd")})
        .withColumn("inflation", F.coalesce(F.try_divide(F.col("assistant_lines").cast("double"), F.col("requests").cast("double")), F.lit(0.0)))
    )
