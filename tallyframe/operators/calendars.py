"""Fiscal calendars of companies as a dimension (company, fiscal_year, quarter, start, end), from filed facts, and what joins by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fiscal

#: What a search can ask for of the newest reports.
PERIODS = ("latest", "latest_10k_and_10q", "latest_10k", "latest_10q")


def latest_info(facts: DataFrame, key: str = "cik", tag: str = "Assets", unit: str = "USD") -> DataFrame:
    """key, end, fy, fp of the newest fact of a tag and unit; one row a company, partial before it moves. Of facts of one end the one with the greatest fy, then fp."""
    newest = F.max(F.struct("end", "fy", "fp"))
    return facts.filter((F.col("tag") == tag) & (F.col("unit") == unit) & F.col("end").isNotNull()).groupBy(key).agg(newest.alias("_n")).select(key, "_n.*")


def end_month(end: Column, fp: Column) -> Column:
    """The month in which fiscal years end, from the end of a period and what it is (Q1 to Q4 or FY); null for anything else."""
    quarter = F.when(F.upper(fp).isin("FY", "Q4"), 4).when(F.upper(fp).rlike("^Q[123]$"), F.substring(fp, 2, 1).cast("int"))
    return (F.pmod(F.month(end) + 3 * (4 - quarter) - 1, F.lit(12)) + 1).cast("int")


def calendar(companies: DataFrame, key: str, month: str, first: str, last: str) -> DataFrame:
    """key, fiscal_year, quarter, start, end of every fiscal quarter that meets the days from first to last (columns of companies, a row a company); no cap."""
    low, high = (fiscal.index(fiscal.year_by_month(F.col(d), F.col(month)), fiscal.quarter_of(F.col(d), F.col(month))) for d in (first, last))
    rows = companies.filter(F.col(first) <= F.col(last)).select(key, F.col(month).alias("_m"), F.explode(F.sequence(low, high)).alias("_q"))
    year, quarter = F.floor(F.col("_q") / 4).cast("int"), (F.pmod("_q", F.lit(4)) + 1).cast("int")
    end = F.last_day(F.add_months(F.make_date(year, F.col("_m"), F.lit(1)), -3 * (4 - quarter)))
    return rows.select(key, year.alias("fiscal_year"), quarter.alias("quarter"), F.trunc(F.add_months(end, -2), "month").alias("start"), end.alias("end"))


def with_quarter(rows: DataFrame, days: DataFrame, key: str, date: str) -> DataFrame:
    """rows with fiscal_year and quarter of their date, from a calendar (inner).

    A quarter is three whole months, so the range is an equi-join on key and month; a row meets one quarter at most."""
    month = F.year(date) * 12 + F.month(date)
    months = days.select(key, "fiscal_year", "quarter", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("_k"), "start")
    months = months.select(key, "fiscal_year", "quarter", (F.year("start") * 12 + F.month("start") + F.col("_k")).alias("_month"))
    return rows.withColumn("_month", month).join(months, [key, "_month"]).drop("_month")


def reports_for(reports: DataFrame, period: str, key: list[str]) -> DataFrame | None:
    """key, form_type, fiscal_year, fiscal_quarter of the newest reports that a search is to be held to; None if the period says nothing. reports: key, form_type, fiscal_year, fiscal_quarter, period_end_date."""
    if period not in PERIODS:
        return None
    yearly = F.col("form_type") == "10-K"
    order = F.struct("period_end_date", "fiscal_year", "fiscal_quarter", "form_type")
    newest = reports.groupBy(*key).agg(F.max(F.when(yearly, order)).alias("k"), F.max(F.when(~yearly, order)).alias("q"))
    both = F.array("k", "q")
    one = F.when(F.coalesce(F.col("q.period_end_date") > F.col("k.period_end_date"), F.col("k").isNull()), F.array("q")).otherwise(F.array("k"))
    wanted = {"latest": one, "latest_10k_and_10q": both, "latest_10k": F.array("k"), "latest_10q": F.array("q")}[period]
    out = newest.select(*key, F.explode(F.filter(wanted, lambda r: r.isNotNull())).alias("r"))
    return out.select(*key, "r.form_type", "r.fiscal_year", "r.fiscal_quarter")


def in_period(chunks: DataFrame, reports: DataFrame, period: str, key: list[str]) -> DataFrame:
    """Chunks of the newest reports of each company, before a search; all, if the period says nothing. A missing quarter is one of its own."""
    held = reports_for(reports, period, key)
    if held is None:
        return chunks
    on = [*key, "form_type", "fiscal_year", "fiscal_quarter"]
    own, there = chunks.alias("c"), held.alias("h")
    met = F.lit(True)
    for c in on:
        met &= F.col(f"c.{c}").eqNullSafe(F.col(f"h.{c}"))
    return own.join(there, met, "left_semi")
