"""Domain views over the test tables, in SQL that Spark and DuckDB read alike.

Amounts are whole cents (BIGINT), so that sums don't depend on their order. Nulls are set by arithmetic on keys, since the
tables have none. `{name}` stands for a table; a view may read the views before it.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import written

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    "company": "SELECT s_suppkey AS cik, s_name AS ticker, n_name AS name, r_name AS sector FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "sale": """
SELECT l_suppkey AS cik, CAST(year(l_shipdate) AS INT) AS fiscal_year, CAST(quarter(l_shipdate) AS INT) AS quarter, l_returnflag AS flag, l_linestatus AS status, l_orderkey AS orderkey,
  CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS rev, CAST(floor(l_extendedprice * 60 + 0.5) AS BIGINT) AS cost, CAST(floor(l_extendedprice * l_tax * 50 + 0.5) AS BIGINT) AS tax, CAST(l_quantity AS BIGINT) AS qty
FROM {lineitem}""",
    "sums": """
SELECT cik, fiscal_year, quarter, sum(rev) AS rev, sum(cost) AS cost, sum(tax) AS tax, sum(qty) AS qty,
  sum(CASE WHEN flag = 'R' THEN rev ELSE 0 END) AS returned, sum(CASE WHEN flag = 'A' THEN rev ELSE 0 END) AS accepted, sum(CASE WHEN status = 'O' THEN rev ELSE 0 END) AS open
FROM sale GROUP BY cik, fiscal_year, quarter""",
    # single quarters, and from the second on the year so far
    "parts": """
SELECT cik, fiscal_year, quarter, CAST(3 AS INT) AS months, CAST(rev AS BIGINT) AS rev, CAST(cost AS BIGINT) AS cost, CAST(tax AS BIGINT) AS tax, CAST(qty AS BIGINT) AS qty, CAST(returned AS BIGINT) AS returned, CAST(accepted AS BIGINT) AS accepted, CAST(open AS BIGINT) AS open FROM sums
UNION ALL
SELECT cik, fiscal_year, quarter, CAST(3 * quarter AS INT) AS months, CAST(rev AS BIGINT) AS rev, CAST(cost AS BIGINT) AS cost, CAST(tax AS BIGINT) AS tax, CAST(qty AS BIGINT) AS qty, CAST(returned AS BIGINT) AS returned, CAST(accepted AS BIGINT) AS accepted, CAST(open AS BIGINT) AS open
FROM (SELECT cik, fiscal_year, quarter, sum(rev) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS rev, sum(cost) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS cost, sum(tax) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS tax, sum(qty) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS qty, sum(returned) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS returned, sum(accepted) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS accepted, sum(open) OVER (PARTITION BY cik, fiscal_year ORDER BY quarter) AS open FROM sums) WHERE quarter > 1""",
    # a row for each company and period; 3 months, 6 and 9 cumulated, 12 as FY
    "income": """
SELECT p.cik, c.ticker, last_day(make_date(fiscal_year, quarter * 3, 1)) AS period_end_date, fiscal_year, CASE WHEN months = 12 THEN 'FY' ELSE concat('Q', CAST(quarter AS VARCHAR(9))) END AS period_type, months AS period_length_months,
  CASE WHEN (p.cik + fiscal_year) % 29 = 3 THEN NULL ELSE rev END AS total_revenue, CASE WHEN (p.cik + fiscal_year + quarter) % 7 = 0 THEN NULL ELSE cost END AS cost_of_revenue, CASE WHEN (p.cik + fiscal_year + quarter) % 5 = 0 THEN NULL ELSE rev - cost END AS gross_profit,
  CASE WHEN p.cik % 2 = 0 THEN CAST(floor(returned * 0.1) AS BIGINT) END AS sales_general_and_admin, CASE WHEN p.cik % 5 <> 0 THEN CAST(floor(returned * 0.06) AS BIGINT) END AS sales_and_marketing,
  CASE WHEN (p.cik + quarter) % 4 <> 0 THEN CAST(floor(returned * 0.04) AS BIGINT) END AS general_and_administrative, CAST(floor(accepted * 0.05) AS BIGINT) AS research_and_development, CASE WHEN p.cik % 3 <> 0 THEN CAST(floor(returned * 0.1) + floor(accepted * 0.05) AS BIGINT) END AS total_operating_expenses,
  CASE WHEN (p.cik + fiscal_year) % 6 <> 0 THEN CAST(rev - cost - floor(returned * 0.1) - floor(accepted * 0.05) AS BIGINT) END AS operating_income, CASE WHEN p.cik % 7 <> 0 THEN qty * 11 END AS interest_income, CASE WHEN p.cik % 8 <> 0 THEN qty * 17 END AS interest_expense, CASE WHEN p.cik % 9 <> 0 THEN qty * 5 - 1000 END AS other_income,
  CASE WHEN (p.cik + quarter) % 3 <> 0 THEN CAST(rev - cost - floor(returned * 0.1) - floor(accepted * 0.05) - qty * 6 AS BIGINT) END AS income_before_taxes, CASE WHEN (p.cik + fiscal_year) % 11 <> 0 THEN tax END AS income_tax_expense,
  CASE WHEN (p.cik + fiscal_year + quarter) % 4 <> 1 THEN CAST(rev - cost - floor(returned * 0.1) - floor(accepted * 0.05) - qty * 6 - tax AS BIGINT) END AS net_income, CASE WHEN p.cik % 6 <> 5 THEN 1000 + qty END AS weighted_average_shares_basic
FROM parts p JOIN company c ON p.cik = c.cik""",
    "cash_flow": """
SELECT p.cik, c.ticker, last_day(make_date(fiscal_year, quarter * 3, 1)) AS period_end_date, fiscal_year, CASE WHEN months = 12 THEN 'FY' ELSE concat('Q', CAST(quarter AS VARCHAR(9))) END AS period_type, months AS period_length_months,
  CASE WHEN (p.cik + quarter) % 13 <> 0 THEN accepted - returned END AS net_cash_from_operating_activities, CASE WHEN p.cik % 3 <> 0 THEN qty * 90 END AS depreciation_and_amortization, CASE WHEN p.cik % 4 <> 1 THEN qty * 70 END AS depreciation, CASE WHEN p.cik % 5 <> 2 THEN qty * 20 END AS amortization,
  CASE WHEN (p.cik + fiscal_year) % 10 <> 0 THEN CAST(floor(open * 0.08) AS BIGINT) END AS capital_expenditures, CASE WHEN (p.cik + quarter) % 6 <> 0 THEN CAST(0 - floor(open * 0.09) AS BIGINT) END AS net_cash_from_investing_activities, CAST(0 - floor(returned * 0.02) AS BIGINT) AS net_cash_from_financing_activities,
  CASE WHEN p.cik % 2 = 0 THEN CAST(accepted - returned - floor(open * 0.09) - floor(returned * 0.02) AS BIGINT) END AS net_change_in_cash, CASE WHEN (p.cik + fiscal_year) % 4 <> 0 THEN qty * 1000 END AS cash_beginning_of_period, CAST(NULL AS BIGINT) AS cash_end_of_period
FROM parts p JOIN company c ON p.cik = c.cik""",
    # dates are up to 80 days off the income statement's
    "balance": """
SELECT b.cik, c.ticker, last_day(make_date(b.fiscal_year, b.quarter * 3, 1)) + CAST((b.cik % 5) * 40 - 80 AS INT) AS period_end_date, b.fiscal_year, CASE WHEN b.cik % 6 = 0 THEN NULL ELSE concat('Q', CAST(b.quarter AS VARCHAR(9))) END AS fiscal_quarter,
  CASE WHEN b.cik % 11 <> 0 THEN rev END AS cash_and_cash_equivalents, CASE WHEN b.cik % 2 = 0 THEN CAST(floor(returned * 0.2) AS BIGINT) END AS short_term_investments, CASE WHEN b.cik % 3 = 0 THEN rev + 5000 END AS cash_and_short_term_investments, CASE WHEN b.quarter <> 3 THEN open + 1 END AS accounts_receivable, qty * 500 AS inventory,
  CASE WHEN (b.cik + b.quarter) % 5 <> 0 THEN rev + open + qty * 500 END AS total_current_assets, cost AS property_plant_equipment, CASE WHEN b.cik % 4 = 0 THEN qty * 40 END AS goodwill, CASE WHEN b.cik % 5 = 1 THEN qty * 30 END AS intangible_assets, CASE WHEN b.cik % 7 = 0 THEN qty * 20 END AS long_term_investments,
  CASE WHEN (b.cik + b.quarter) % 6 <> 0 THEN cost + qty * 70 END AS total_non_current_assets, CASE WHEN (b.cik + b.fiscal_year) % 4 <> 0 THEN rev + open + cost + qty * 570 END AS total_assets, CASE WHEN b.cik % 9 <> 0 THEN CAST(floor(cost * 0.3) AS BIGINT) END AS accounts_payable, CAST(floor(tax * 0.5) AS BIGINT) AS accrued_liabilities,
  CASE WHEN b.cik % 8 = 0 THEN qty * 9 END AS commercial_paper, CASE WHEN b.cik % 3 = 1 THEN qty * 8 END AS other_short_term_borrowings, CASE WHEN b.cik % 2 = 1 THEN qty * 7 END AS current_portion_long_term_debt, CASE WHEN b.cik % 4 = 3 THEN qty * 6 END AS finance_lease_liability_current, CASE WHEN b.cik % 5 = 3 THEN qty * 5 END AS operating_lease_liability_current,
  CASE WHEN (b.cik + b.quarter) % 7 <> 0 THEN CAST(floor(cost * 0.4) AS BIGINT) END AS total_current_liabilities, CASE WHEN b.cik % 3 <> 2 THEN CAST(floor(cost * 0.25) AS BIGINT) END AS long_term_debt, CASE WHEN b.cik % 4 <> 2 THEN CAST(floor(cost * 0.2) AS BIGINT) END AS non_current_long_term_debt,
  CASE WHEN b.cik % 6 = 1 THEN qty * 4 END AS finance_lease_liability_noncurrent, CASE WHEN b.cik % 6 = 2 THEN qty * 3 END AS operating_lease_liability_noncurrent, CASE WHEN (b.cik + b.quarter) % 8 <> 0 THEN CAST(floor(cost * 0.5) AS BIGINT) END AS total_liabilities, CASE WHEN (b.cik + b.fiscal_year) % 9 <> 0 THEN CAST(rev + open + cost + qty * 570 - floor(cost * 0.5) AS BIGINT) END AS total_stockholders_equity
FROM parts b JOIN company c ON b.cik = c.cik WHERE b.months = 3""",
    "price": """
SELECT concat('U', CAST(user_id AS VARCHAR(20))) AS ticker, CAST(ts AS DATE) AS date, min_by(value, event_id) AS open_price, max(value) AS high_price, min(value) AS low_price, max_by(value, event_id) AS close_price, count(*) AS volume, max_by(event_type, event_id) AS source
FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "chunk": """
SELECT doc_id AS id, text AS content, source AS ticker, lang AS section_name, CASE WHEN doc_id % 3 = 0 THEN '10-K' ELSE '10-Q' END AS form_type, CAST(2015 + doc_id % 9 AS VARCHAR(9)) AS fiscal_year, CASE WHEN doc_id % 3 = 0 THEN 'FY' ELSE CAST(1 + doc_id % 4 AS VARCHAR(9)) END AS fiscal_quarter, n_chars
FROM {documents}""",
    "entry": "SELECT conv_id, CAST(turn AS INT) AS seq, role AS speaker, text AS content, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS is_analyst, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS is_management FROM {conversations}",
    "news": "SELECT page_id AS chunk_id, url AS source_url, CAST(page_id % 60 AS INT) AS age_days, CASE WHEN page_id % 7 = 0 THEN NULL WHEN page_id % 3 = 0 THEN 'positive' WHEN page_id % 3 = 1 THEN 'negative' ELSE 'neutral' END AS sentiment, concat('C', CAST(page_id % 11 AS VARCHAR(9))) AS company, make_date(2024, 3, 1) + CAST(0 - page_id % 60 AS INT) AS published FROM {pages}",
    "usage": "SELECT concat('run', CAST(conv_id % 40 AS VARCHAR(9))) AS run_id, CASE WHEN role = 'user' THEN 'analyst' WHEN role = 'assistant' THEN 'reviewer' ELSE 'master' END AS agent_type, concat('m', CAST(conv_id % 3 AS VARCHAR(9))) AS model_id, CAST(length(text) AS BIGINT) AS input_tokens, CAST(turn * 10 + 1 AS BIGINT) AS output_tokens FROM {conversations}",
}


def _needed(sql: str, given: dict[str, str] | None = None) -> list[str]:
    """Views that the text reads, with those that they read, in order; what is given reads nothing."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                if name not in (given or {}):
                    todo.append(VIEWS[name])
    return [n for n in VIEWS if n in found]


def oracle(sql: str) -> str:
    """The query for DuckDB, with the views that it reads."""
    heads = [f"{n} AS ({VIEWS[n]})" for n in _needed(sql)]
    body = sql.strip()
    text = "WITH " + ", ".join(heads) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body) if heads else body
    return re.sub(r"\{(\w+)\}", r"\1", text)


def view(spark: SparkSession, sf_dir: str, name: str, given: dict[str, str] | None = None) -> DataFrame:
    """A view as a DataFrame; only the columns that a query uses are read. given: views that are tables already, by name (see based())."""
    text, given = VIEWS[name], given or {}
    needed = [n for n in _needed(text, given) if n != name]
    heads = [f"{n} AS (SELECT * FROM {given[n]})" if n in given else f"{n} AS ({VIEWS[n]})" for n in needed]
    text = ("WITH " + ", ".join(heads) + " " if heads else "") + text
    return spark.sql(re.sub(r"\{(\w+)\}", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))


def based(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The sums of sales by company and period as a table, for plans that read several views of them: the sales are scanned once."""
    name = f"parts_{uuid.uuid4().hex}"
    written(view(spark, sf_dir, "parts")).createOrReplaceTempView(name)
    return {"parts": name}


def shared(spark: SparkSession, sf_dir: str, name: str, key: str = "cik", given: dict[str, str] | None = None) -> DataFrame:
    """A view that a plan reads several times (a few rows a company and period, however many sales they sum up): dealt out by company once and kept, so that the sales are scanned once, and windows and joins by company need no further exchange. What an executor loses is computed again. It stays with the session until spark.catalog.clearCache(), which a long session has to call between reports, as bench.py does between queries."""
    return view(spark, sf_dir, name, given).repartition(key).persist()
