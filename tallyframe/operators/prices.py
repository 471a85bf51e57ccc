"""Price series: returns, trend, volatility, risk, signals, peers, gaps.

A series is the rows of one ticker, ordered by date. Sums for deviations are made from rounded returns, so that their order
doesn't matter to the digits that are shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, rounded


def cleaned(prices: DataFrame, most: float = 50.0) -> DataFrame:
    """Rows with a close above 0; adjusted_close from close where it's missing; `large_move` marks a day that moved by more than so many percent."""
    out = prices.filter(F.col("close_price").isNotNull() & (F.col("close_price") > 0))
    if "adjusted_close" in out.columns:
        out = out.withColumn("adjusted_close", F.coalesce("adjusted_close", "close_price"))
    move = F.abs(ratio(F.col("close_price") - F.col("open_price"), F.col("open_price"))) * 100
    return out.withColumn("large_move", F.coalesce(move > most, F.lit(False)))


def with_returns(prices: DataFrame) -> DataFrame:
    """daily_return in percent (6 digits), place from the start and from the end, and the length of the series."""
    w = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    before = F.lag("close_price").over(w)
    out = prices.withColumn("daily_return", rounded(ratio(F.col("close_price") - before, before) * 100))
    return out.withColumn("place", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("back", F.col("n") - F.col("place"))


def deviation(value: Column, when: Column | None = None) -> Column:
    """Sample deviation from whole millionths; null for fewer than two values."""
    v = F.when(when, value) if when is not None else value
    units = F.round(v * 1_000_000).cast("decimal(18,0)")
    n, total, squares = F.count(v), F.sum(units).cast("double"), F.sum(units * units).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1))) / 1_000_000.0)


def trend_of(n: Column, first: Column, last: Column, high: Column, low: Column, mean: Column) -> Column:
    change = ratio(last - first, first) * 100
    return F.when(n < 5, "insufficient_data").when(change > 5, "upward").when(change < -5, "downward").when(ratio(high - low, mean) * 100 < 10, "sideways").otherwise("volatile")


def volatility_class(v: Column) -> Column:
    return F.when(v < 1.5, "low").when(v < 3.0, "medium").when(v < 5.0, "high").otherwise("very_high")


def risk_of(v: Column, worst: Column) -> Column:
    base = F.when(v < 2.0, "low").when(v < 4.0, "medium").otherwise("high")
    return F.when(worst < -10, "high").when((worst < -5) & (base == "low"), "medium").otherwise(base)


def metrics(prices: DataFrame) -> DataFrame:
    """One row a ticker: total and annualised return, volatility and its class, trend, risk, high, low, mean volume. Two rows at least."""
    s = with_returns(prices)
    out = s.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("close_price", "date").alias("first"), F.max_by("close_price", "date").alias("last"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.max("close_price").alias("high"), F.min("close_price").alias("low"), (F.sum(F.round(F.col("close_price") * 1_000_000).cast("decimal(18,0)")).cast("double") / F.count(F.lit(1)) / 1_000_000.0).alias("mean"),
        deviation(F.col("daily_return")).alias("volatility"), F.min("daily_return").alias("worst"), F.avg("volume").alias("volume"),
    )
    total = ratio(F.col("last") - F.col("first"), F.col("first")) * 100
    days = F.greatest(F.datediff("end", "start"), F.lit(1))
    v = F.coalesce("volatility", F.lit(0.0))
    return out.filter("n > 1").select(
        "ticker", "n", rounded(total, 2).alias("total_return"), rounded(total * 365 / days, 2).alias("annualised_return"), rounded(v, 4).alias("volatility"), "high", "low", rounded(F.col("volume"), 4).alias("mean_volume"),
        trend_of(F.col("n"), F.col("first"), F.col("last"), F.col("high"), F.col("low"), F.col("mean")).alias("trend"), volatility_class(v).alias("volatility_class"), risk_of(v, F.col("worst")).alias("risk"),
    )


def recent(prices: DataFrame, days: int = 30) -> DataFrame:
    """Return of the last rows of a series against that of the rows before; series of `days` rows at least."""
    s = with_returns(prices).filter(F.col("n") >= days)
    new = F.col("back") < days
    pick = lambda when, by: F.min_by(F.when(when, F.col("close_price")), F.when(when, by))
    out = s.groupBy("ticker").agg(pick(new, F.col("place")).alias("a"), pick(new, -F.col("place")).alias("b"), pick(~new, F.col("place")).alias("c"), pick(~new, -F.col("place")).alias("d"))
    now, was = ratio(F.col("b") - F.col("a"), F.col("a")) * 100, ratio(F.col("d") - F.col("c"), F.col("c")) * 100
    relative = now - F.coalesce(was, F.lit(0.0))
    return out.select("ticker", rounded(now, 2).alias("recent_return"), rounded(relative, 2).alias("relative_performance"), (relative > 0).alias("accelerating"))


#: What signals say.
SIGNALS = ("Insufficient data for signal generation", "Recent upward momentum detected", "Recent downward pressure observed", "Increased volatility in recent trading", "Volatility compression noted", "Above-average trading volume", "Below-average trading volume", "Trading near period high", "Trading near period low")


def signals(prices: DataFrame) -> DataFrame:
    """At most five observations a ticker, in a fixed order."""
    s = with_returns(prices)
    last = lambda k: F.col("back") < k
    close = F.col("close_price")
    micro = F.round(close * 1_000_000).cast("decimal(18,0)")
    g = s.groupBy("ticker").agg(
        F.first("n").alias("n"), F.count("daily_return").alias("returns"), F.max_by(close, "date").alias("now"), F.max("close_price").alias("high"), F.min("close_price").alias("low"),
        F.count(F.when(last(20), 1)).alias("n20"), F.min_by(F.when(last(20), close), F.when(last(20), F.col("place"))).alias("a20"), F.max(F.when(last(20), close)).alias("h20"), F.min(F.when(last(20), close)).alias("l20"), (F.sum(F.when(last(20), micro)).cast("double") / F.count(F.when(last(20), 1)) / 1_000_000.0).alias("m20"),
        deviation(F.col("daily_return"), last(10)).alias("v10"), deviation(F.col("daily_return")).alias("v"), F.avg(F.when(last(10), F.col("volume"))).alias("q10"), F.avg("volume").alias("q"), F.count("volume").alias("volumes"),
    )
    trend = trend_of(F.col("n20"), F.col("a20"), F.col("now"), F.col("h20"), F.col("l20"), F.col("m20"))
    v10 = F.when(F.col("returns") >= 10, F.col("v10")).otherwise(0.0)
    busy = F.col("volumes") > 20
    found = F.array(
        F.when(trend == "upward", SIGNALS[1]).when(trend == "downward", SIGNALS[2]),
        F.when(v10 > F.col("v") * 1.5, SIGNALS[3]).when(v10 < F.col("v") * 0.5, SIGNALS[4]),
        F.when(busy & (F.col("q10") > F.col("q") * 1.3), SIGNALS[5]).when(busy & (F.col("q10") < F.col("q") * 0.7), SIGNALS[6]),
        F.when(F.col("now") >= F.col("high") * 0.95, SIGNALS[7]).when(F.col("now") <= F.col("low") * 1.05, SIGNALS[8]),
    )
    short = F.col("n") < 10
    return g.select("ticker", F.when(short, F.array(F.lit(SIGNALS[0]))).otherwise(F.slice(F.filter(found, lambda x: x.isNotNull()), 1, 5)).alias("signals"))


def ranked_peers(returns: DataFrame, group: list[str]) -> DataFrame:
    """Rank of total_return within a group of peers (a tie goes by ticker), quartile tier, and the difference to the mean of the others."""
    w = Window.partitionBy(*group)
    rank, total = F.row_number().over(w.orderBy(F.desc("total_return"), "ticker")), F.count(F.lit(1)).over(w)
    cents = F.round(F.col("total_return") * 100).cast("long")
    others = (F.sum(cents).over(w) - cents) / F.when(total > 1, (total - 1) * 100.0)
    share = rank / total
    tier = F.when(share <= 0.25, "top quartile").when(share <= 0.5, "second quartile").when(share <= 0.75, "third quartile").otherwise("bottom quartile")
    return returns.select(*group, "ticker", "total_return", rank.alias("rank"), total.alias("total"), tier.alias("tier"), rounded(F.col("total_return") - others, 2).alias("relative"))


def missing_ranges(prices: DataFrame, start: str, end: str, weekends: bool = False) -> DataFrame:
    """Runs of days without a price, of weekdays only: a weekend ends a run, as the next day is then not the day after."""
    days = F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 day"))).alias("date")
    expected = prices.select("ticker").distinct().select("ticker", days)
    if not weekends:
        expected = expected.filter(F.weekday("date") < 5)
    gone = expected.join(prices.select("ticker", "date"), ["ticker", "date"], "left_anti")
    island = F.date_sub("date", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    return gone.withColumn("island", island).groupBy("ticker", "island").agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(F.lit(1)).alias("days")).drop("island")


def statistics(prices: DataFrame) -> DataFrame:
    return prices.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("first"), F.max("date").alias("last"))


def by_source(prices: DataFrame) -> DataFrame:
    return prices.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def latest(prices: DataFrame) -> DataFrame:
    return prices.groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close_price", "date").alias("close_price"), F.min("date").alias("first"), F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def hit_rate(requested: DataFrame, cached: DataFrame, key: list[str]) -> DataFrame:
    """Share of requested keys that the cache holds."""
    seen = requested.select(*key).distinct().join(cached.select(*key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return seen.agg(F.count(F.lit(1)).alias("requested"), F.count("_hit").alias("hits"), rounded(F.count("_hit") / F.count(F.lit(1)), 6).alias("rate"))
