"""Queries of scans, joins, windows, merges and comparisons, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import period
from ..functions.catalog import RATIOS, VIRTUAL
from ..operators import alignment as al, facts, fundamentals as fu, relational as re_
from . import fundamentals
from .views import oracle, shared, view


def scan_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").filter("cik = 1")
    return rows.select("cik", "period_end_date", "period_type", "period_length_months", "total_revenue").orderBy(F.desc("period_end_date"), "period_type", "period_length_months").limit(10)


def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "price").filter(F.col("ticker").isin("U1", "U2", "U3") & F.col("date").between("2024-01-05", "2024-01-20")).select("ticker", "date", "close_price", "volume")


def ratio_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios with their definitions; the definitions are the catalog, a constant of the plan."""
    values = fu.ratios(fundamentals._periods(spark, sf_dir), RATIOS, VIRTUAL, False).select("cik", "period_end_date", "ratio_name", "ratio_value")
    definitions = spark.createDataFrame([(n, c, f) for n, c, f in RATIOS], "ratio_name string, category string, formula string")
    return values.join(F.broadcast(definitions), "ratio_name").filter("category = 'liquidity'").select("cik", "period_end_date", "ratio_name", "formula", "ratio_value")


_FORMULAS = "CASE ratio_name " + " ".join(f"WHEN '{n}' THEN '{t}'" for n, _, t in RATIOS) + " END"
RATIO_JOIN = oracle(f"WITH {fundamentals._PERIODS}, {fundamentals._virtual_sql()}, long_ AS ({fundamentals._ratio_sql()}) SELECT cik, period_end_date, ratio_name, {_FORMULAS} AS formula, floor(v * 1e6 + 0.5) / 1e6 AS ratio_value FROM long_ WHERE v IS NOT NULL AND category = 'liquidity'")


def statement_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all three kinds in one sparse frame."""
    parts = [view(spark, sf_dir, n).withColumn("statement_type", F.lit(n)).select("cik", "period_end_date", "statement_type", *cols) for n, cols in (("income", ["period_type", "total_revenue"]), ("cash_flow", ["period_type", "net_cash_from_operating_activities"]), ("balance", ["total_assets"]))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


STATEMENT_UNION = oracle("""SELECT cik, period_end_date, 'income' AS statement_type, period_type, total_revenue, CAST(NULL AS BIGINT) AS net_cash_from_operating_activities, CAST(NULL AS BIGINT) AS total_assets FROM income
UNION ALL SELECT cik, period_end_date, 'cash_flow', period_type, NULL, net_cash_from_operating_activities, NULL FROM cash_flow UNION ALL SELECT cik, period_end_date, 'balance', NULL, NULL, NULL, total_assets FROM balance""")


def combined_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals._periods(spark, sf_dir).select("cik", "period_end_date", "total_revenue", "net_cash_from_operating_activities", "balance_date", "total_assets")


COMBINED = oracle(f"WITH {fundamentals._PERIODS} SELECT cik, period_end_date, total_revenue, net_cash_from_operating_activities, balance_date, total_assets FROM periods")


def period_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit("1994-06-01"))) % 400
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(facts.months_of(days).alias("months")).groupBy("months").agg(F.count(F.lit(1)).alias("n"))


def _ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "income").filter("period_length_months = 3 or period_type = 'FY'").filter("period_type <> 'FY'").select("cik", "period_end_date", "fiscal_year", F.col("period_type").alias("fiscal_quarter"), "total_revenue")


def _period(text: str):
    return lambda spark, sf_dir: period.of_ratios(_ratios(spark, sf_dir), text)


_R = "r AS (SELECT cik, period_end_date, fiscal_year, period_type AS fiscal_quarter, total_revenue FROM income WHERE period_length_months = 3)"
_RANKED = "SELECT cik, period_end_date, fiscal_year, fiscal_quarter, total_revenue FROM (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY {0} DESC) AS k FROM r {2}) WHERE k <= {1}"


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = shared(spark, sf_dir, "income")
    own = income.select("cik", "period_end_date", "fiscal_year", "period_type", "total_revenue", F.lit("income").alias("statement_type"), F.lit("filed").alias("data_source"))
    last = fu.ltm(income).select("cik", "period_end_date", "fiscal_year", "period_type", "total_revenue", F.lit("income").alias("statement_type"), F.lit("LTM").alias("data_source"))
    return own.unionByName(last)


def statements_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period.of_statements(_statements(spark, sf_dir), "Q2-2000")


def statements_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period.of_statements(_statements(spark, sf_dir), "latest")


_ST = f"{fundamentals._LTM_INCOME}, st AS (SELECT cik, period_end_date, fiscal_year, period_type, total_revenue, 'income' AS statement_type, 'filed' AS data_source FROM income UNION ALL SELECT cik, period_end_date, fiscal_year, period_type, total_revenue, 'income', 'LTM' FROM ltm_)"


def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = view(spark, sf_dir, "income").filter("period_length_months = 3").select("cik", "period_end_date", "total_revenue")
    right = view(spark, sf_dir, "balance").select("cik", F.col("period_end_date").alias("balance_date"), "total_assets")
    return fu.nearest(left, right, "period_end_date", "balance_date", 90)


ASOF = oracle("""SELECT cik, period_end_date, total_revenue, balance_date, total_assets FROM (SELECT i.cik, i.period_end_date, i.total_revenue, b.period_end_date AS balance_date, b.total_assets,
  row_number() OVER (PARTITION BY i.cik, i.period_end_date ORDER BY abs(date_diff('day', b.period_end_date, i.period_end_date)), b.period_end_date DESC) AS rn
  FROM (SELECT * FROM income WHERE period_length_months = 3) i LEFT JOIN balance b ON i.cik = b.cik AND abs(date_diff('day', b.period_end_date, i.period_end_date)) <= 90) WHERE rn = 1""")


def fuzzy_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer against shipments of the supplier of the same number, within five days."""
    left = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("cik"), F.to_date("o_orderdate").alias("filed")).distinct()
    right = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("cik"), F.to_date("l_shipdate").alias("reported")).distinct()
    return re_.fuzzy_dates(left, right, ["cik"], "filed", "reported")


FUZZY = """SELECT cik, filed, reported FROM (SELECT o.cik, filed, reported, row_number() OVER (PARTITION BY o.cik, filed ORDER BY abs(date_diff('day', reported, filed)), reported) AS rn
  FROM (SELECT DISTINCT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filed FROM orders) o JOIN (SELECT DISTINCT l_suppkey AS cik, CAST(l_shipdate AS DATE) AS reported FROM lineitem) l ON o.cik = l.cik AND abs(date_diff('day', reported, filed)) <= 5) WHERE rn = 1"""


def forward_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next fiscal year after each quarter; the quarter's year is at most that."""
    income = view(spark, sf_dir, "income")
    left = income.filter("period_length_months = 3").select("cik", "period_end_date", (F.col("fiscal_year") + (F.col("cik") % 3).cast("int")).alias("fiscal_year"))
    right = income.filter("period_type = 'FY'").select("cik", F.col("period_end_date").alias("year_end"), F.col("fiscal_year").alias("cap"))
    return re_.next_after(left, right, ["cik"], "period_end_date", "year_end").select("cik", "period_end_date", "year_end", F.least("fiscal_year", "cap").alias("fiscal_year"))


FORWARD = oracle("""SELECT cik, period_end_date, year_end, least(fy, cap) AS fiscal_year FROM (SELECT q.cik, q.period_end_date, f.period_end_date AS year_end, CAST(q.fiscal_year + q.cik % 3 AS INT) AS fy, f.fiscal_year AS cap, row_number() OVER (PARTITION BY q.cik, q.period_end_date ORDER BY f.period_end_date) AS rn
  FROM income q JOIN income f ON q.cik = f.cik AND f.period_type = 'FY' AND f.period_end_date > q.period_end_date WHERE q.period_length_months = 3) WHERE rn = 1""")


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "company").select(F.col("cik").alias("company_id"), F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("category")) for n, c, _ in RATIOS[::2]))))
    return rows.filter("(company_id + length(name)) % 3 = 0")


def override_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = spark.createDataFrame([(n, c) for n, c, _ in RATIOS], "name string, category string")
    return re_.overridden(_definitions(spark, sf_dir), common)


_NAMES = ", ".join(f"('{n}', '{c}', {k})" for k, (n, c, _) in enumerate(RATIOS))
_DEFS = f"names AS (SELECT * FROM (VALUES {_NAMES}) x(name, category, k)), own AS (SELECT cik AS company_id, n.name, n.category FROM company c, names n WHERE k % 2 = 0 AND (cik + length(n.name)) % 3 = 0)"


def scoped_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    common = spark.createDataFrame([(None, n, c) for n, c, _ in RATIOS], "company_id long, name string, category string")
    return re_.scoped(_definitions(spark, sf_dir).unionByName(common), 3, "ROE")


def dedup_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").withColumn("start", F.when(F.col("cik") % 3 != 0, F.col("period_end_date")))
    return re_.best_rows(rows, ["cik", "period_end_date"], "start", ["total_revenue", "gross_profit", "net_income"], F.col("period_length_months")).select("cik", "period_end_date", "period_length_months")


def coalesce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return re_.coalesced(view(spark, sf_dir, "income"), ["cik", "fiscal_year"], ["gross_profit", "net_income", "operating_income"], F.col("period_end_date"), F.col("period_length_months"))


COALESCE = oracle("SELECT cik, fiscal_year, min_by(gross_profit, k) FILTER (gross_profit IS NOT NULL) AS gross_profit, min_by(net_income, k) FILTER (net_income IS NOT NULL) AS net_income, min_by(operating_income, k) FILTER (operating_income IS NOT NULL) AS operating_income FROM (SELECT *, row_number() OVER (PARTITION BY cik, fiscal_year ORDER BY period_end_date, period_length_months) AS k FROM income) GROUP BY cik, fiscal_year")


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "income").groupBy("cik").agg(F.count(F.lit(1)).alias("rows"), F.sum(re_.completeness_rows(None, fu.REQUIRED["income"])).alias("filled"), F.round(F.avg(F.col("total_revenue").isNotNull().cast("int")), 6).alias("coverage"))


_FILLED = " + ".join(f"(CASE WHEN {n} IS NOT NULL AND {n} <> 0 THEN 1 ELSE 0 END)" for n in fu.REQUIRED["income"])


def peer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").filter("period_type = 'FY'").join(view(spark, sf_dir, "company").select("cik", "sector"), "cik").select("sector", "fiscal_year", F.col("net_income").cast("double").alias("v"))
    return re_.peer_stats(rows, ["sector", "fiscal_year"], "v", 1)


def mode_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent fiscal quarter of each company (the first of several), else the calendar quarter of its last date."""
    rows = view(spark, sf_dir, "balance")
    return rows.groupBy("cik").agg(F.coalesce(F.mode("fiscal_quarter", True), F.concat(F.lit("Q"), F.quarter(F.max("period_end_date")).cast("string"))).alias("fiscal_quarter"))


def _old_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "income").filter("period_type = 'FY'").select("cik", "fiscal_year", "gross_profit", "net_income")
    return rows.filter("fiscal_year <= 1999"), rows.filter("fiscal_year >= 1998 and net_income is not null").withColumn("net_income", F.col("net_income") + 1)


_ON = "old AS (SELECT cik, fiscal_year, gross_profit, net_income FROM income WHERE period_type = 'FY' AND fiscal_year <= 1999), new_ AS (SELECT cik, fiscal_year, gross_profit, net_income + 1 AS net_income FROM income WHERE period_type = 'FY' AND fiscal_year >= 1998 AND net_income IS NOT NULL)"
_KEY = ["cik", "fiscal_year"]


def compare_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peers of a sector in one period: category, ratio, and its statistics."""
    values = fu.ratios(fundamentals._periods(spark, sf_dir), RATIOS, VIRTUAL, False).filter("fiscal_year = 1999").join(view(spark, sf_dir, "company").select("cik", "sector"), "cik")
    return re_.peer_stats(values.withColumnRenamed("ratio_value", "v"), ["sector", "category", "ratio_name"], "v")


def cluster_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventories of all companies, a peer group being a sector."""
    return al.cluster_quarters(_aligned(spark, sf_dir))


def align_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last balance sheet of each fiscal year of all companies."""
    return al.align_years(_aligned(spark, sf_dir, "quarter = 4"))


def _aligned(spark: SparkSession, sf_dir: str, which: str = "true") -> DataFrame:
    rows = view(spark, sf_dir, "balance").withColumn("quarter", F.quarter(F.date_sub("period_end_date", (F.col("cik") % 5).cast("int") * 40 - 80))).filter(which)
    return rows.join(view(spark, sf_dir, "company").select("cik", "sector"), "cik").select(F.col("sector").alias("ratio_name"), "ticker", "period_end_date", (F.col("inventory") / 100).cast("double").alias("ratio_value"))


_DAY = "date_diff('day', DATE '1970-01-01', period_end_date)"
_QUEUE = """al AS (SELECT c.sector AS ratio_name, b.ticker, b.period_end_date, CAST(b.inventory AS DOUBLE) / 100 AS ratio_value FROM balance b JOIN company c ON b.cik = c.cik WHERE {}),
q AS (SELECT *, row_number() OVER (PARTITION BY ratio_name, ticker ORDER BY period_end_date DESC, ratio_value) AS k FROM al)"""
_CENTERED = f"done AS (SELECT *, DATE '1970-01-01' + CAST(trunc(CAST(sum({_DAY}) OVER g AS DOUBLE) / count(*) OVER g) AS INT) AS center FROM r WHERE taken WINDOW g AS (PARTITION BY ratio_name, period_number))"


def _recursive(sql: str) -> str:
    return oracle(sql).replace("WITH ", "WITH RECURSIVE ", 1)


_ROUND = "period_end_date >= max(period_end_date) OVER (PARTITION BY ratio_name) - 45 AS taken"
CLUSTERED = f"""WITH {_QUEUE.format("true")},
r AS (SELECT ratio_name, ticker, period_end_date, ratio_value, k, CAST(1 AS INT) AS period_number, {_ROUND} FROM q WHERE k = 1
UNION ALL SELECT ratio_name, ticker, period_end_date, ratio_value, k, period_number, {_ROUND} FROM (SELECT q.*, r.period_number + 1 AS period_number FROM r JOIN q ON q.ratio_name = r.ratio_name AND q.ticker = r.ticker AND q.k = r.k + CAST(r.taken AS INT))),
{_CENTERED}"""
_TAKEN = f"""SELECT ratio_name, ticker, period_end_date, ratio_value, k, period_number, taken AND sum(CAST(taken AS INT)) OVER (PARTITION BY ratio_name) >= 2 AS taken, sum(CAST(taken AS INT)) OVER (PARTITION BY ratio_name) >= 2 AS goes_on
FROM (SELECT *, NOT bool_or(far) OVER (PARTITION BY ratio_name ORDER BY period_end_date DESC, ticker ROWS UNBOUNDED PRECEDING) AS taken
FROM (SELECT *, coalesce(avg({_DAY}) OVER (PARTITION BY ratio_name ORDER BY period_end_date DESC, ticker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DAY} > 180, false) AS far FROM ({{}})))"""
YEARS_ALIGNED = f"""WITH {_QUEUE.format("quarter(b.period_end_date - CAST((b.cik % 5) * 40 - 80 AS INT)) = 4")},
r AS ({_TAKEN.format("SELECT *, CAST(1 AS INT) AS period_number FROM q WHERE k = 1")}
UNION ALL {_TAKEN.format("SELECT q.*, r.period_number + 1 AS period_number FROM r JOIN q ON q.ratio_name = r.ratio_name AND q.ticker = r.ticker AND q.k = r.k + CAST(r.taken AS INT) WHERE r.goes_on")}),
{_CENTERED}"""
_ALIGNED = " SELECT ratio_name, period_number, center, ticker, period_end_date, ratio_value FROM done"
SUMMARIES = _recursive(CLUSTERED + " SELECT ratio_name, period_number, center, count(*) AS companies, min(ratio_value) AS lowest, max(ratio_value) AS highest, CAST(avg(CAST(ratio_value AS DECIMAL(20,6))) AS DOUBLE) AS mean, min(period_end_date) AS first, max(period_end_date) AS last FROM done GROUP BY ratio_name, period_number, center")
_PLAIN = "SELECT cik, period_end_date, fiscal_year, fiscal_quarter, total_revenue FROM r WHERE "
QUERIES = {
    "scan_ordered_limit": (scan_ordered, oracle("SELECT cik, period_end_date, period_type, period_length_months, total_revenue FROM income WHERE cik = 1 ORDER BY period_end_date DESC, period_type, period_length_months LIMIT 10")),
    "price_range_scan": (price_range, oracle("SELECT ticker, date, close_price, volume FROM price WHERE ticker IN ('U1', 'U2', 'U3') AND date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")),
    "ratio_join_scan": (ratio_join, RATIO_JOIN),
    "statement_union": (statement_union, STATEMENT_UNION),
    "combined_frame": (combined_frame, COMBINED),
    "period_bucket": (period_bucket, "SELECT CAST(CASE WHEN d > 330 THEN 12 WHEN d > 240 THEN 9 WHEN d > 150 THEN 6 ELSE 3 END AS INT) AS months, count(*) AS n FROM (SELECT date_diff('day', DATE '1994-06-01', CAST(l_shipdate AS DATE)) % 400 AS d FROM lineitem) GROUP BY 1"),
    "period_filter_latest": (_period("latest"), oracle(f"WITH {_R} {_RANKED.format('period_end_date', 1, '')}")),
    "period_filter_year": (lambda s, d: period.of_ratios(_ratios(s, d), "FY2000"), oracle(f"WITH {_R} {_PLAIN} fiscal_year = 2000 AND fiscal_quarter = 'Q4'")),
    "period_filter_quarter": (_period("Q3-2001"), oracle(f"WITH {_R} {_PLAIN} fiscal_year = 2001 AND fiscal_quarter = 'Q3'")),
    "period_filter_last_quarters": (_period("last 6 quarters"), oracle(f"WITH {_R} {_RANKED.format('fiscal_year * 4 + CAST(substr(fiscal_quarter, 2, 1) AS INT)', 6, '')}")),
    "period_filter_last_years": (_period("last 3 financial years"), oracle(f"WITH {_R} {_RANKED.format('fiscal_year', 3, chr(10) + 'WHERE fiscal_quarter = ' + chr(39) + 'Q4' + chr(39))}")),
    "statements_quarter": (statements_quarter, oracle(f"WITH {_ST}, own AS (SELECT * FROM st WHERE period_type = 'Q2' AND fiscal_year = 2000 AND data_source <> 'LTM') SELECT * FROM own UNION ALL SELECT * FROM st WHERE data_source = 'LTM' AND (cik, period_end_date) IN (SELECT (cik, period_end_date) FROM own)")),
    "statements_latest": (statements_latest, oracle(f"WITH {_ST} SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY cik, statement_type ORDER BY period_end_date DESC) AS k FROM st WHERE data_source = 'LTM') WHERE k = 1")),
    "asof_nearest_90d": (asof_nearest, ASOF),
    "fuzzy_date_5d": (fuzzy_date, FUZZY),
    "forward_asof_cap": (forward_asof, FORWARD),
    "override_anti_union": (override_union, oracle(f"WITH {_DEFS} SELECT company_id, name, category, 1 AS priority FROM own UNION ALL SELECT o.company_id, n.name, n.category, 2 FROM (SELECT DISTINCT company_id FROM own) o, names n WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.company_id = o.company_id AND x.name = n.name)")),
    "scoped_lookup": (scoped_lookup, oracle(f"WITH {_DEFS} SELECT company_id, name, category FROM (SELECT company_id, name, category FROM own WHERE company_id = 3 UNION ALL SELECT NULL, name, category FROM names) WHERE name = 'ROE' ORDER BY company_id NULLS LAST LIMIT 1")),
    "dedup_best_row": (dedup_best, oracle("SELECT cik, period_end_date, period_length_months FROM (SELECT *, row_number() OVER (PARTITION BY cik, period_end_date ORDER BY cik % 3 <> 0 DESC, (total_revenue IS NOT NULL)::INT + (gross_profit IS NOT NULL)::INT + (net_income IS NOT NULL)::INT DESC, period_length_months) AS rn FROM income) WHERE rn = 1")),
    "coalesce_rows_per_period": (coalesce_rows, COALESCE),
    "completeness_score": (completeness, oracle(f"SELECT cik, count(*) AS rows, CAST(sum({_FILLED}) AS BIGINT) AS filled, round(avg(CASE WHEN total_revenue IS NOT NULL THEN 1 ELSE 0 END), 6) AS coverage FROM income GROUP BY cik")),
    "peer_stats_upper_median": (peer_stats, oracle("SELECT sector, fiscal_year, count(*) AS n, max(v) AS highest, min(v) AS lowest, floor(CAST(sum(CAST(v AS BIGINT)) AS DOUBLE) / count(*) / 1 * 1e6 + 0.5) / 1e6 AS average, list_sort(list(v))[count(*) // 2 + 1] AS median FROM (SELECT sector, fiscal_year, CAST(net_income AS DOUBLE) AS v FROM income JOIN company USING (cik) WHERE period_type = 'FY' AND net_income IS NOT NULL) GROUP BY sector, fiscal_year")),
    "mode_quarter": (mode_quarter, oracle("SELECT c.cik, coalesce(m.fiscal_quarter, concat('Q', CAST(quarter(c.d) AS VARCHAR))) AS fiscal_quarter FROM (SELECT cik, max(period_end_date) AS d FROM balance GROUP BY cik) c LEFT JOIN (SELECT cik, fiscal_quarter FROM (SELECT cik, fiscal_quarter, row_number() OVER (PARTITION BY cik ORDER BY count(*) DESC, fiscal_quarter) AS rn FROM balance WHERE fiscal_quarter IS NOT NULL GROUP BY cik, fiscal_quarter) WHERE rn = 1) m ON c.cik = m.cik")),
    "upsert_overwrite": (lambda s, d: re_.upsert(*_old_new(s, d), _KEY), oracle(f"WITH {_ON} SELECT * FROM new_ UNION ALL SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM new_ n WHERE n.cik = o.cik AND n.fiscal_year = o.fiscal_year)")),
    "upsert_coalesce": (lambda s, d: re_.upsert_known(*_old_new(s, d), _KEY), oracle(f"WITH {_ON} SELECT coalesce(n.cik, o.cik) AS cik, coalesce(n.fiscal_year, o.fiscal_year) AS fiscal_year, coalesce(n.gross_profit, o.gross_profit) AS gross_profit, coalesce(n.net_income, o.net_income) AS net_income FROM old o FULL JOIN new_ n ON o.cik = n.cik AND o.fiscal_year = n.fiscal_year")),
    "insert_if_absent": (lambda s, d: re_.insert_absent(*_old_new(s, d), _KEY), oracle(f"WITH {_ON} SELECT * FROM old UNION ALL SELECT * FROM new_ n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.cik = o.cik AND n.fiscal_year = o.fiscal_year)")),
    "insert_counts": (lambda s, d: re_.insert_counts(*_old_new(s, d), _KEY), oracle(f"WITH {_ON} SELECT count(*) FILTER (o.cik IS NULL) AS inserted, count(*) FILTER (o.cik IS NOT NULL) AS skipped FROM new_ n LEFT JOIN old o ON n.cik = o.cik AND n.fiscal_year = o.fiscal_year")),
    "retention_delete": (lambda s, d: re_.retained(view(s, d, "price").select("ticker", "date", "volume"), "date", "2024-01-15"), oracle("SELECT ticker, date, volume FROM price WHERE date >= DATE '2024-01-15'")),
    "compare_single": (compare_single, oracle(f"WITH {fundamentals._PERIODS}, {fundamentals._virtual_sql()}, long_ AS ({fundamentals._ratio_sql()}), v AS (SELECT sector, category, ratio_name, floor(l.v * 1e6 + 0.5) / 1e6 AS v FROM long_ l JOIN company USING (cik) WHERE l.v IS NOT NULL AND year(period_end_date) = 1999) SELECT sector, category, ratio_name, count(*) AS n, max(v) AS highest, min(v) AS lowest, floor(CAST(sum(CAST(round(v * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000 * 1e6 + 0.5) / 1e6 AS average, list_sort(list(v))[count(*) // 2 + 1] AS median FROM v GROUP BY ALL")),
    "cluster_quarters": (cluster_quarters, _recursive(CLUSTERED + _ALIGNED)),
    "align_years": (align_years, _recursive(YEARS_ALIGNED + _ALIGNED)),
}
