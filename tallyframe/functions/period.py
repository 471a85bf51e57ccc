"""The little language of periods, and the predicates it stands for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR, MOST_QUARTERS, MOST_YEARS = 2000, 2030, 40, 10


@dataclass(frozen=True)
class Period:
    """kind: latest, ltm, year, quarter, quarters or years; year, quarter and n where they apply."""

    kind: str
    year: int = 0
    quarter: int = 0
    n: int = 0


def parse(text: str) -> Period:
    """latest, LTM, FY2024, Q1-2024, last n quarters (1-40), last n financial years (1-10); upper and lower case alike. ValueError for anything else."""
    t = " ".join(text.strip().lower().split())
    if t in ("latest", "ltm"):
        return Period(t)
    if m := re.fullmatch(r"fy(\d{4})", t):
        found = Period("year", year=int(m[1]))
    elif m := re.fullmatch(r"q([1-4])-(\d{4})", t):
        found = Period("quarter", year=int(m[2]), quarter=int(m[1]))
    elif (m := re.fullmatch(r"last (\d+) quarters?", t)) and 1 <= int(m[1]) <= MOST_QUARTERS:
        return Period("quarters", n=int(m[1]))
    elif (m := re.fullmatch(r"last (\d+) financial years?", t)) and 1 <= int(m[1]) <= MOST_YEARS:
        return Period("years", n=int(m[1]))
    else:
        raise ValueError(f"not a period: {text!r}")
    if not FIRST_YEAR <= found.year <= LAST_YEAR:
        raise ValueError(f"year out of range: {text!r}")
    return found


def canonical(text: str) -> str:
    """What users write for a period, in the little language.

    n years or ny -> last 4n quarters; n quarters or nq -> last n quarters; latest, current, last -> latest; another number is years up to 20, else
    quarters; anything else is three years. The result may be beyond what parse() takes."""
    t = " ".join(text.strip().lower().split())
    try:
        parse(t)
        return t
    except ValueError:
        pass
    if t in ("latest", "current", "last"):
        return "latest"
    if m := re.search(r"(\d+)\s*(years?|quarters?)", t):
        return f"last {int(m[1]) * (4 if m[2].startswith('year') else 1)} quarters"
    if m := re.fullmatch(r"(\d+)([yq])", t):
        return f"last {int(m[1]) * (4 if m[2] == 'y' else 1)} quarters"
    if m := re.search(r"(\d+)", t):
        return f"last {int(m[1]) * (1 if int(m[1]) > 20 else 4)} quarters"
    return "last 12 quarters"


REPORT_PERIODS = ("latest", "latest_10k_and_10q", "latest_10k", "latest_10q", "last_n_reports")


def report_period(text: str) -> str:
    """Periods of a search for reports: last n, last n years, n years and n reports -> last_n_reports; those known stay; anything else is latest."""
    t = text.strip()
    if m := re.fullmatch(r"last\s+(\d+)(?:\s+years?)?|(\d+)\s+(?:years?|reports?)", t.lower()):
        return f"last_{m[1] or m[2]}_reports"
    return t if t in REPORT_PERIODS or re.fullmatch(r"last_\d+_reports", t) else "latest"


def quarter_index(year: Column, quarter: Column) -> Column:
    return year * 4 + quarter


def of_ratios(df: DataFrame, text: str, key: tuple[str, ...] = ("cik",)) -> DataFrame:
    """Rows (fiscal_year, fiscal_quarter Q1-Q4, period_end_date) of a period, for each company by itself. Years are their Q4 rows, where a company has any."""
    p = parse(text)
    last = Window.partitionBy(*key).orderBy(F.desc(quarter_index(F.col("fiscal_year"), F.substring("fiscal_quarter", 2, 1).cast("int"))))
    newest = Window.partitionBy(*key).orderBy(F.desc("period_end_date"))
    if p.kind in ("latest", "ltm"):
        return df.withColumn("_r", F.dense_rank().over(newest)).filter("_r = 1").drop("_r")
    if p.kind == "year":
        return df.filter((F.col("fiscal_year") == p.year) & (F.col("fiscal_quarter") == "Q4"))
    if p.kind == "quarter":
        return df.filter((F.col("fiscal_year") == p.year) & (F.col("fiscal_quarter") == f"Q{p.quarter}"))
    if p.kind == "quarters":
        return df.withColumn("_r", F.dense_rank().over(last)).filter(F.col("_r") <= p.n).drop("_r")
    return _years(df, p.n, key)


def _years(df: DataFrame, n: int, key: tuple[str, ...]) -> DataFrame:
    """The n newest fiscal years of each company: its Q4 rows; if it has none its FY rows; if it has none of these either, the last date of each year."""
    company = Window.partitionBy(*key)
    kind = F.col("period_type") if "period_type" in df.columns else F.lit(None).cast("string")
    q4, fy = F.coalesce(F.col("fiscal_quarter") == "Q4", F.lit(False)), F.coalesce(kind == "FY", F.lit(False))
    last = F.col("period_end_date") == F.max("period_end_date").over(Window.partitionBy(*key, "fiscal_year"))
    marked = df.withColumn("_way", F.when(F.max(q4).over(company), q4).when(F.max(fy).over(company), fy).otherwise(last)).filter("_way")
    return marked.withColumn("_r", F.dense_rank().over(company.orderBy(F.desc("fiscal_year")))).filter(F.col("_r") <= n).drop("_r", "_way")


def of_statements(df: DataFrame, text: str, key: tuple[str, ...] = ("cik",)) -> DataFrame:
    """Statement rows (statement_type, data_source, period_type, fiscal_year, period_end_date) of a period.

    latest: the newest LTM of each statement type. A year: its FY rows, and LTM rows of the same dates. A quarter: its rows and LTM of the
    same dates. The last n quarters or years: rows of the n newest dates of LTM, or of the n newest FY."""
    p = parse(text)
    if p.kind in ("latest", "ltm"):
        w = Window.partitionBy(*key, "statement_type").orderBy(F.desc("period_end_date"))
        return df.filter("data_source = 'LTM'").withColumn("_r", F.dense_rank().over(w)).filter("_r = 1").drop("_r")
    if p.kind in ("year", "quarter"):
        kind = "FY" if p.kind == "year" else f"Q{p.quarter}"
        own = df.filter((F.col("period_type") == kind) & (F.col("fiscal_year") == p.year) & (F.col("data_source") != "LTM"))
        dates = own.select(*key, "period_end_date").distinct()
        return own.unionByName(df.filter("data_source = 'LTM'").join(dates, [*key, "period_end_date"], "left_semi"))
    source = df.filter("data_source = 'LTM'") if p.kind == "quarters" else df.filter("period_type = 'FY' and data_source <> 'LTM'")
    w = Window.partitionBy(*key).orderBy(F.desc("period_end_date"))
    return source.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= p.n).drop("_r")
