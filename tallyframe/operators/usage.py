"""Token usage to cost; trends and quality of what was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded

MILLION = 1_000_000


def priced(usage: DataFrame, prices: dict[str, tuple[float, float]], default: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """With input and output cost: tokens / 1e6 * price of the model (a constant of the plan)."""
    pick = lambda k: F.coalesce(*(F.when(F.col("model_id") == m, p[k]) for m, p in prices.items()), F.lit(default[k]))
    return usage.withColumns({"input_cost": F.col("input_tokens") / MILLION * pick(0), "output_cost": F.col("output_tokens") / MILLION * pick(1)})


def rollup(usage: DataFrame, prices: dict[str, tuple[float, float]], *keys: str) -> DataFrame:
    """Tokens and cost by keys; costs are of summed tokens, so they don't depend on order."""
    sums = usage.groupBy(*keys, "model_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count(F.lit(1)).alias("calls"))
    out = priced(sums, prices).withColumn("micros", F.round((F.col("input_cost") + F.col("output_cost")) * MILLION).cast("long"))
    return out.groupBy(*keys).agg(F.sum("calls").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), (F.sum("micros") / MILLION).alias("cost"))


def trend(rows: DataFrame, key: list[str], date: str, value: str, n: int = 4, band: float = 0.05) -> DataFrame:
    """improving, declining or stable: the last of the n newest values (by date) against the first of them, with a band of 5 %; insufficient_data for fewer than two."""
    newest = Window.partitionBy(*key).orderBy(F.desc(date))
    last = rows.filter(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n)
    out = last.groupBy(*key).agg(F.min_by(value, date).alias("first"), F.max_by(value, date).alias("last"), F.count(F.lit(1)).alias("n"))
    first, end = F.col("first").cast("double"), F.col("last").cast("double")
    return out.withColumn("trend", F.when(F.col("n") < 2, "insufficient_data").when(end > first * (1 + band), "improving").when(end < first * (1 - band), "declining").otherwise("stable"))


def confidence(level: Column) -> Column:
    """3, 2 or 1 for high, medium and anything else."""
    return F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)


def confidence_level(mean: Column) -> Column:
    return F.when(mean >= 2.5, "high").when(mean >= 1.5, "medium").otherwise("low")


def quality(metrics: Column, ratios: Column, peers: Column, errors: Column) -> Column:
    """0 to 1: up to 0.4 for ten metrics, up to 0.4 for eight ratios, 0.2 for any peers, 0.1 less for each error (0.3 at most)."""
    score = F.least(metrics / 10.0, F.lit(1.0)) * 0.4 + F.least(ratios / 8.0, F.lit(1.0)) * 0.4 + F.when(peers > 0, 0.2).otherwise(0.0)
    return rounded(F.greatest(F.lit(0.0), score - F.least(errors * 0.1, F.lit(0.3))), 2)
