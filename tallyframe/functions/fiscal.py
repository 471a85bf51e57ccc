"""Fiscal calendars, as Columns; a fiscal year end is its month, or MMDD as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def year_of(date: Column, mmdd: Column) -> Column:
    """Fiscal year of a date, by the day on which years end."""
    return F.year(date) + F.when(F.date_format(date, "MMdd") > mmdd, 1).otherwise(0)


def year_by_month(date: Column, end_month: Column | int) -> Column:
    """Fiscal year of a date, by the month in which years end."""
    return F.year(date) + F.when(F.month(date) > end_month, 1).otherwise(0)


def quarter_of(date: Column, end_month: Column | int) -> Column:
    """Fiscal quarter of a date: 4 is the one that ends in the end month."""
    months = F.pmod(F.month(date) - end_month - 1, F.lit(12))
    return (F.floor(months / 3) + 1).cast("int")


def quarter_starts(end_month: int) -> list[int]:
    return [(end_month + 3 * k) % 12 + 1 for k in range(4)]


def index(year: Column, quarter: Column) -> Column:
    """Quarters in one count, so that steps are sums: year * 4 + quarter - 1."""
    return year * 4 + quarter - 1


def previous(year: Column, quarter: Column, n: Column | int = 1) -> tuple[Column, Column]:
    at = index(year, quarter) - n
    return F.floor(at / 4).cast("int"), (F.pmod(at, F.lit(4)) + 1).cast("int")


def quarters_between(df: DataFrame, start: str, end: str, first_year: int | None = None, most: int | None = None, end_month: Column | int = 12) -> DataFrame:
    """A row for each fiscal quarter from start to end, newest first, by the month in which a company's years end; not before first_year, and `most` at most, if given."""
    at = lambda d: index(year_by_month(F.col(d), end_month), quarter_of(F.col(d), end_month))
    low = at(start) if first_year is None else F.greatest(at(start), F.lit(first_year * 4))
    all_ = F.reverse(F.sequence(low, at(end)))
    span = F.when(at(end) >= low, all_ if most is None else F.slice(all_, 1, most)).otherwise(F.array().cast("array<int>"))
    return df.select("*", F.explode(span).alias("_q")).select("*", F.floor(F.col("_q") / 4).cast("int").alias("year"), (F.pmod("_q", F.lit(4)) + 1).cast("int").alias("quarter")).drop("_q")


def filing_date_of(name: Column) -> Column:
    """January 1 of the year in a file name like 0000320193-24-000123; two digits over 50 are of the last century."""
    yy = F.regexp_extract(name, r"\d{10}-(\d{2})-\d{6}", 1).try_cast("int")
    return F.make_date(yy + F.when(yy > 50, 1900).otherwise(2000), F.lit(1), F.lit(1))


def latest_year_and_quarter(reports: DataFrame, key: list[str]) -> DataFrame:
    """The newest yearly and the newest quarterly report of each key, and which of them is the newer (a tie goes to the yearly)."""
    yearly = F.col("form_type") == "10-K"
    order = F.struct("fiscal_year", "fiscal_quarter", "period_end_date")
    out = reports.groupBy(*key).agg(F.max(F.when(yearly, order)).alias("k"), F.max(F.when(~yearly, order)).alias("q"))
    newer = F.when(F.coalesce(F.col("q.period_end_date") > F.col("k.period_end_date"), F.col("k").isNull()), "10-Q").otherwise("10-K")
    return out.select(*key, F.col("k.fiscal_year").alias("latest_year"), F.col("k.period_end_date").alias("year_end"), F.col("q.fiscal_year").alias("quarter_year"), F.col("q.fiscal_quarter").alias("latest_quarter"), F.col("q.period_end_date").alias("quarter_end"), newer.alias("newest"))
