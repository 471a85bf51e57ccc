"""Queries of price series, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices as pr
from .views import oracle, view


def _price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pr.cleaned(view(spark, sf_dir, "price"))


_S = """
s0 AS (SELECT *, lag(close_price) OVER (PARTITION BY ticker ORDER BY date) AS before FROM price WHERE close_price > 0),
s AS (SELECT *, floor((close_price - before) / nullif(before, 0) * 100 * 1e6 + 0.5) / 1e6 AS daily_return, row_number() OVER (PARTITION BY ticker ORDER BY date) AS place, count(*) OVER (PARTITION BY ticker) AS n, count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY date) AS back FROM s0)"""


def _dev(x: str) -> str:
    u = f"CAST(round({x} * 1000000) AS DECIMAL(18, 0))"
    t, q = f"CAST(sum({u}) AS DOUBLE)", f"CAST(sum(CAST({u} AS HUGEINT) * CAST({u} AS HUGEINT)) AS DOUBLE)"
    return f"CASE WHEN count({x}) > 1 THEN sqrt(greatest(0.0, ({q} - {t} * {t} / count({x})) / (count({x}) - 1))) / 1000000.0 END"


_TREND = "CASE WHEN {n} < 5 THEN 'insufficient_data' WHEN ({b} - {a}) / {a} * 100 > 5 THEN 'upward' WHEN ({b} - {a}) / {a} * 100 < -5 THEN 'downward' WHEN ({h} - {l}) / {m} * 100 < 10 THEN 'sideways' ELSE 'volatile' END"
_METRICS = f"""{_S},
g AS (SELECT ticker, count(*) AS n, min_by(close_price, date) AS first_, max_by(close_price, date) AS last_, min(date) AS a, max(date) AS b, max(close_price) AS high, min(close_price) AS low, CAST(sum(CAST(round(close_price * 1000000) AS DECIMAL(18, 0))) AS DOUBLE) / count(*) / 1000000.0 AS mean_, coalesce({_dev("daily_return")}, 0.0) AS v, min(daily_return) AS worst, avg(volume) AS volume FROM s GROUP BY ticker),
metrics AS (SELECT ticker, n, floor((last_ - first_) / first_ * 100 * 100.0 + 0.5) / 100.0 AS total_return, floor((last_ - first_) / first_ * 100 * 365 / greatest(date_diff('day', a, b), 1) * 100.0 + 0.5) / 100.0 AS annualised_return, floor(v * 10000.0 + 0.5) / 10000.0 AS volatility, high, low, floor(volume * 10000.0 + 0.5) / 10000.0 AS mean_volume,
  {_TREND.format(n="n", a="first_", b="last_", h="high", l="low", m="mean_")} AS trend, CASE WHEN v < 1.5 THEN 'low' WHEN v < 3 THEN 'medium' WHEN v < 5 THEN 'high' ELSE 'very_high' END AS volatility_class,
  CASE WHEN worst < -10 THEN 'high' WHEN worst < -5 AND v < 2 THEN 'medium' WHEN v < 2 THEN 'low' WHEN v < 4 THEN 'medium' ELSE 'high' END AS risk FROM g WHERE n > 1)"""
_L20 = "CASE WHEN back < 20 THEN close_price END"
_SIGNALS = f"""{_S},
g AS (SELECT ticker, any_value(n) AS n, count(daily_return) AS r, max_by(close_price, date) AS b, max(close_price) AS h, min(close_price) AS l, count({_L20}) AS n20, min_by(close_price, place) FILTER (back < 20) AS a20, max({_L20}) AS h20, min({_L20}) AS l20, CAST(sum(CAST(round({_L20} * 1000000) AS DECIMAL(18, 0))) AS DOUBLE) / count({_L20}) / 1000000.0 AS m20,
  {_dev("CASE WHEN back < 10 THEN daily_return END")} AS v10, {_dev("daily_return")} AS v, avg(CASE WHEN back < 10 THEN volume END) AS q10, avg(volume) AS q, count(volume) AS qs FROM s GROUP BY ticker),
t AS (SELECT *, {_TREND.format(n="n20", a="a20", b="b", h="h20", l="l20", m="m20")} AS trend, CASE WHEN r >= 10 THEN v10 ELSE 0.0 END AS w FROM g)
SELECT ticker, CASE WHEN n < 10 THEN ['{pr.SIGNALS[0]}'] ELSE list_filter([CASE WHEN trend = 'upward' THEN '{pr.SIGNALS[1]}' WHEN trend = 'downward' THEN '{pr.SIGNALS[2]}' END, CASE WHEN w > v * 1.5 THEN '{pr.SIGNALS[3]}' WHEN w < v * 0.5 THEN '{pr.SIGNALS[4]}' END,
  CASE WHEN qs > 20 AND q10 > q * 1.3 THEN '{pr.SIGNALS[5]}' WHEN qs > 20 AND q10 < q * 0.7 THEN '{pr.SIGNALS[6]}' END, CASE WHEN b >= h * 0.95 THEN '{pr.SIGNALS[7]}' WHEN b <= l * 1.05 THEN '{pr.SIGNALS[8]}' END], lambda x: x IS NOT NULL) END AS signals FROM t"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of 30 rows and more: prices by event type and hour."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max_by("value", "event_id").alias("close_price"), F.count(F.lit(1)).alias("volume"))


_DENSE = "dense AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, max_by(value, event_id) AS close_price, count(*) AS volume FROM events GROUP BY 1, 2)"


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.metrics(_price(spark, sf_dir)).select(F.substring("ticker", 1, 2).alias("peers"), "ticker", "total_return")
    return pr.ranked_peers(rows, ["peers"])


PEERS = oracle(f"""WITH {_METRICS}, r AS (SELECT substr(ticker, 1, 2) AS peers, ticker, total_return, CAST(round(total_return * 100) AS BIGINT) AS c FROM metrics),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY peers ORDER BY total_return DESC, ticker) AS INT) AS rank, count(*) OVER (PARTITION BY peers) AS total, sum(c) OVER (PARTITION BY peers) AS s FROM r)
SELECT peers, ticker, total_return, rank, total, CASE WHEN rank / total <= 0.25 THEN 'top quartile' WHEN rank / total <= 0.5 THEN 'second quartile' WHEN rank / total <= 0.75 THEN 'third quartile' ELSE 'bottom quartile' END AS tier, floor((total_return - (s - c) / CASE WHEN total > 1 THEN (total - 1) * 100.0 END) * 100.0 + 0.5) / 100.0 AS relative FROM w""")

MISSING = oracle("""WITH days AS (SELECT CAST(d AS DATE) AS date FROM range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY) t(d) WHERE isodow(d) < 6),
gone AS (SELECT ticker, date FROM (SELECT DISTINCT ticker FROM price) t, days EXCEPT SELECT ticker, date FROM price),
i AS (SELECT ticker, date, date - CAST(row_number() OVER (PARTITION BY ticker ORDER BY date) AS INT) AS island FROM gone)
SELECT ticker, min(date) AS start_date, max(date) AS end_date, count(*) AS days FROM i GROUP BY ticker, island""")

QUERIES = {
    "daily_returns": (lambda s, d: pr.with_returns(_price(s, d)).select("ticker", "date", "daily_return", "place"), oracle(f"WITH {_S} SELECT ticker, date, daily_return, place FROM s")),
    "price_metrics": (lambda s, d: pr.metrics(_price(s, d)), oracle(f"WITH {_METRICS} SELECT * FROM metrics")),
    "price_trend": (lambda s, d: pr.metrics(_price(s, d)).groupBy("trend", "volatility_class", "risk").agg(F.count(F.lit(1)).alias("n")), oracle(f"WITH {_METRICS} SELECT trend, volatility_class, risk, count(*) AS n FROM metrics GROUP BY ALL")),
    "recent_performance": (lambda s, d: pr.recent(_dense(s, d), 10), f"""WITH {_DENSE}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS place, count(*) OVER (PARTITION BY ticker) - row_number() OVER (PARTITION BY ticker ORDER BY date) AS back, count(*) OVER (PARTITION BY ticker) AS n FROM dense),
g AS (SELECT ticker, min_by(close_price, place) FILTER (back < 10) AS a, max_by(close_price, place) FILTER (back < 10) AS b, min_by(close_price, place) FILTER (back >= 10) AS c, max_by(close_price, place) FILTER (back >= 10) AS d FROM p WHERE n >= 10 GROUP BY ticker), r AS (SELECT ticker, (b - a) / a * 100 AS now_, coalesce((d - c) / c * 100, 0.0) AS was FROM g)
SELECT ticker, floor(now_ * 100.0 + 0.5) / 100.0 AS recent_return, floor((now_ - was) * 100.0 + 0.5) / 100.0 AS relative_performance, now_ - was > 0 AS accelerating FROM r"""),
    "trading_signals": (lambda s, d: pr.signals(_price(s, d)), oracle(f"WITH {_SIGNALS}")),
    "peer_rank": (peers, PEERS),
    "missing_ranges": (lambda s, d: pr.missing_ranges(view(s, d, "price"), "2024-01-01", "2024-01-30"), MISSING),
    "price_statistics": (lambda s, d: pr.statistics(view(s, d, "price")), oracle("SELECT count(*) AS rows, count(DISTINCT ticker) AS tickers, min(date) AS first, max(date) AS last FROM price")),
    "price_sources": (lambda s, d: pr.by_source(view(s, d, "price")), oracle("SELECT source, count(*) AS n FROM price GROUP BY source")),
    "latest_price": (lambda s, d: pr.latest(view(s, d, "price")), oracle("SELECT ticker, max(date) AS date, max_by(close_price, date) AS close_price, min(date) AS first, count(*) AS n FROM price GROUP BY ticker")),
    "large_moves": (lambda s, d: _price(s, d).select("ticker", "date", "large_move"), oracle("SELECT ticker, date, coalesce(abs((close_price - open_price) / nullif(open_price, 0)) * 100 > 50, false) AS large_move FROM price WHERE close_price > 0")),
    "null_counts": (lambda s, d: pr.null_counts(view(s, d, "income").select("total_revenue", "gross_profit", "net_income")), oracle("SELECT count(*) - count(total_revenue) AS total_revenue, count(*) - count(gross_profit) AS gross_profit, count(*) - count(net_income) AS net_income FROM income")),
    "duplicate_periods": (lambda s, d: pr.duplicates(view(s, d, "income"), ["cik", "period_end_date"]), oracle("SELECT cik, period_end_date, count(*) AS n FROM income GROUP BY ALL HAVING count(*) > 1")),
    "cache_hit_rate": (lambda s, d: pr.hit_rate(view(s, d, "price"), view(s, d, "price").filter("date < '2024-01-20'"), ["ticker", "date"]), oracle("SELECT count(*) AS requested, count(*) FILTER (date < DATE '2024-01-20') AS hits, floor(count(*) FILTER (date < DATE '2024-01-20') / count(*) * 1e6 + 0.5) / 1e6 AS rate FROM price")),
}
