"""Queries of summaries and checks, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import RATIOS, VIRTUAL
from ..operators import alignment as al, chunks as ch, facts, fundamentals as fu, news as nw, relational as rel, summaries as su, transcripts as tr, usage as us
from . import chunk_sql, fundamentals, relational
from .views import oracle, shared, view


def _catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c, f) for n, c, f in RATIOS], "ratio_name string, category string, formula string")


_NAMES = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', '{f}')" for n, c, f in RATIOS) + ") x(ratio_name, category, formula))"


def computed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns from tags, where the direct tag is missing in some rows."""
    wide = view(spark, sf_dir, "income").select("cik", "period_end_date", "period_length_months", F.col("total_revenue").alias("Revenues"), F.col("cost_of_revenue").alias("CostOfRevenue"), "gross_profit", F.col("gross_profit").alias("GrossProfit"), F.col("total_operating_expenses").alias("OperatingExpenses"), "operating_income")
    return facts.computed(wide).select("cik", "period_end_date", "period_length_months", "gross_profit", "operating_income")


def tag_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.coverage(fundamentals._fact(spark, sf_dir)).select("column", F.array_join("tags", ",").alias("tags"), "n")


def ltm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fu.ltm(shared(spark, sf_dir, "income"))
    return rows.groupBy("calculation_method", "period_type").agg(F.count(F.lit(1)).alias("n"), F.min("period_end_date").alias("first"), F.max("period_end_date").alias("last"))


def latest_ltm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return su.latest(fu.ltm(shared(spark, sf_dir, "income")), ["cik"], "period_end_date", "total_revenue", "calculation_method")


def nested_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = su.nested(fu.ratios(fundamentals._periods(spark, sf_dir), RATIOS, VIRTUAL, False), ["cik", "period_end_date"])
    inner = F.from_json(F.col("categories")["liquidity"], "map<string, double>")
    return out.select("cik", "period_end_date", F.array_join(F.map_keys("categories"), ",").alias("categories"), inner["Cash_Ratio"].alias("cash_ratio"))


NESTED = oracle(f"WITH {fundamentals._PERIODS}, {fundamentals._virtual_sql()}, long_ AS ({fundamentals._ratio_sql()}) SELECT cik, period_end_date, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, max(CASE WHEN ratio_name = 'Cash_Ratio' THEN floor(v * 1e6 + 0.5) / 1e6 END) AS cash_ratio FROM long_ WHERE v IS NOT NULL GROUP BY cik, period_end_date")


def definition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every company asks for: a name in full, parts of names, and one that there isn't."""
    asked = view(spark, sf_dir, "company").select("cik", F.element_at(F.array(*map(F.lit, ASKED)), (F.col("cik") % len(ASKED) + 1).cast("int")).alias("asked"))
    return su.by_definition(asked, _catalog(spark)).select("cik", "asked", "ratio_name", "category", "tier")


ASKED = ("roe", "Margin", "cash", "turnover", "none such")
LOOKUP = oracle(f"""WITH {_NAMES}, a AS (SELECT cik, list_extract({list(ASKED)}, CAST(cik % {len(ASKED)} + 1 AS INT)) AS asked FROM company), m AS (SELECT a.cik, a.asked, n.*, CASE WHEN lower(asked) = lower(ratio_name) THEN 0 ELSE 1 END AS tier FROM a JOIN names n ON contains(lower(ratio_name), lower(asked)))
SELECT cik, asked, ratio_name, category, CAST(tier AS INT) AS tier FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY tier, length(ratio_name), ratio_name) AS rn FROM m) WHERE rn = 1""")


def interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fu.ratios(fundamentals._periods(spark, sf_dir), RATIOS, VIRTUAL, False).groupBy("ratio_name", "category").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("ratio_name", "n", su.interpretation(F.col("ratio_name")).alias("says"))


_SAYS = "CASE ratio_name " + " ".join(f"WHEN '{n}' THEN '" + t.replace("'", "''") + "'" for n, t in su.SAYS.items()) + " END"
INTERPRET = oracle(f"WITH {fundamentals._PERIODS}, {fundamentals._virtual_sql()}, long_ AS ({fundamentals._ratio_sql()}), r AS (SELECT ratio_name, category, count(*) AS n FROM long_ WHERE v IS NOT NULL GROUP BY ALL) SELECT ratio_name, n, {_SAYS} AS says FROM r")


def metadata_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    income = view(spark, sf_dir, "income").filter("period_length_months in (3, 12)")
    filings = income.select("cik", F.when(F.col("period_type") == "FY", "10-K").otherwise("10-Q").alias("form_type"), F.date_add("period_end_date", 30 + F.col("period_length_months")).alias("filed"), (F.col("fiscal_year") + 1).alias("fiscal_year"))
    known = income.filter("gross_profit is not null").select("cik", F.date_add("period_end_date", F.lit(32) + F.col("period_length_months")).alias("fact_filed"), F.col("fiscal_year").alias("fact_year"))
    years = income.filter("period_type = 'FY'").select("cik", F.date_add("period_end_date", 42).alias("year_filed"), F.col("fiscal_year").alias("year"))
    return su.corrected_years(filings, known, years)


CORRECTION = oracle("""WITH i AS (SELECT * FROM income WHERE period_length_months IN (3, 12)), f AS (SELECT cik, CASE WHEN period_type = 'FY' THEN '10-K' ELSE '10-Q' END AS form_type, period_end_date + 30 + period_length_months AS filed, fiscal_year + 1 AS fiscal_year FROM i),
k AS (SELECT cik, period_end_date + 32 + period_length_months AS d, fiscal_year AS y FROM i WHERE gross_profit IS NOT NULL), b AS (SELECT f.cik, form_type, filed, k.y, row_number() OVER (PARTITION BY f.cik, form_type, filed ORDER BY abs(date_diff('day', d, filed)), d, y) AS rn FROM f JOIN k ON f.cik = k.cik AND abs(date_diff('day', d, filed)) <= 5),
n AS (SELECT f.cik, form_type, filed, i.fiscal_year AS cap, row_number() OVER (PARTITION BY f.cik, form_type, filed ORDER BY i.period_end_date) AS rn FROM f JOIN i ON f.cik = i.cik AND i.period_type = 'FY' AND i.period_end_date + 42 > filed WHERE form_type = '10-Q')
SELECT f.cik, f.form_type, f.filed, f.fiscal_year, least(coalesce(b.y, f.fiscal_year), coalesce(n.cap, b.y, f.fiscal_year)) AS corrected FROM f LEFT JOIN b ON f.cik = b.cik AND f.form_type = b.form_type AND f.filed = b.filed AND b.rn = 1 LEFT JOIN n ON f.cik = n.cik AND f.form_type = n.form_type AND f.filed = n.filed AND n.rn = 1""")


def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><th>k</th><th>"), F.col("page_id").cast("string"), F.lit("</th></tr><tr><td>v</td><td> a  b</td></tr></table>"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.concat("html", html).alias("html"))
    return ch.html_tables(pages, "page_id", "html").filter("text like '%\t%'").select(F.col("id").alias("page_id"), F.regexp_replace("text", "\t", "|").alias("cells"))


def quarter_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of periods, the newest first; labels of years are no quarters and come last."""
    labels = view(spark, sf_dir, "income").select(F.concat("period_type", F.lit("-"), F.col("fiscal_year").cast("string")).alias("label")).distinct()
    year, quarter = su.quarter_order(F.col("label"))
    return labels.select("label", year.alias("year"), quarter.alias("quarter")).orderBy(F.desc_nulls_last("year"), F.desc_nulls_last("quarter"), "label")


QUERIES = {
    "computed_fields": (computed_fields, oracle("SELECT cik, period_end_date, period_length_months, coalesce(gross_profit, total_revenue - cost_of_revenue) AS gross_profit, coalesce(operating_income, gross_profit - total_operating_expenses, total_revenue - cost_of_revenue - total_operating_expenses) AS operating_income FROM income")),
    "tag_coverage": (tag_coverage, fundamentals._fact_oracle("""SELECT "column", string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(*) AS n FROM (SELECT tag, CASE WHEN lower(tag) IN ('revenues', 'salesrevenuenet') THEN 'total_revenue' WHEN tag = 'CostOfRevenue' THEN 'cost_of_revenue' WHEN tag = 'NetIncomeLoss' THEN 'net_income' END AS "column" FROM fact WHERE tag <> 'UnknownTag') GROUP BY "column" HAVING count(DISTINCT tag) > 1""")),
    "company_summary": (lambda s, d: su.company_summary(view(s, d, "income")), oracle("SELECT cik, ticker, count(*) AS rows, min(period_end_date) AS first, max(period_end_date) AS last, floor(count(*) FILTER (total_revenue <> 0) / count(*) * 1e6 + 0.5) / 1e6 AS revenue_coverage, count(DISTINCT period_type) AS period_types, count(*) FILTER (period_type = 'FY') AS years FROM income GROUP BY cik, ticker")),
    "company_problems": (lambda s, d: su.problems(su.company_summary(view(s, d, "income").filter("gross_profit is not null")), 40).select("cik", F.array_join("problems", ",").alias("problems")), oracle("SELECT cik, 'few rows' AS problems FROM income WHERE gross_profit IS NOT NULL GROUP BY cik HAVING count(*) < 40")),
    "ltm_summary": (ltm_summary, oracle(f"WITH {fundamentals._LTM_INCOME} SELECT calculation_method, period_type, count(*) AS n, min(period_end_date) AS first, max(period_end_date) AS last FROM ltm_ GROUP BY ALL")),
    "latest_ltm": (latest_ltm, oracle(f"WITH {fundamentals._LTM_INCOME} SELECT cik, period_end_date, total_revenue, calculation_method FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end_date DESC) AS rn FROM ltm_) WHERE rn = 1")),
    "adhoc_metric": (lambda s, d: su.adhoc(view(s, d, "income"), "metric", ["total_revenue"], ["cost_of_revenue", "research_and_development"]).select("cik", "period_end_date", "period_length_months", "metric"), oracle("SELECT cik, period_end_date, period_length_months, coalesce(total_revenue, 0) - coalesce(cost_of_revenue, 0) - coalesce(research_and_development, 0) AS metric FROM income")),
    "nested_ratios": (nested_ratios, NESTED),
    "definition_lookup": (definition_lookup, LOOKUP),
    "ratio_interpretation": (interpretations, INTERPRET),
    "consecutive_growth": (lambda s, d: su.consecutive_growth(view(s, d, "income").filter("period_type = 'FY' and total_revenue is not null"), "total_revenue"), oracle("SELECT a.cik, a.fiscal_year, floor(CAST(a.total_revenue - b.total_revenue AS DOUBLE) / b.total_revenue * 1e6 + 0.5) / 1e6 AS growth FROM income a JOIN income b ON a.cik = b.cik AND b.fiscal_year = a.fiscal_year - 1 AND b.period_type = 'FY' WHERE a.period_type = 'FY' AND a.total_revenue IS NOT NULL AND b.total_revenue <> 0")),
    "quarter_sort": (quarter_sort, oracle("SELECT DISTINCT concat(period_type, '-', CAST(fiscal_year AS VARCHAR)) AS label, CASE WHEN period_type <> 'FY' THEN fiscal_year END AS year, CASE WHEN period_type <> 'FY' THEN CAST(substr(period_type, 2, 1) AS INT) END AS quarter FROM income")),
    "index_coverage": (lambda s, d: su.missing_years(view(s, d, "chunk"), ["ticker"], 2015, 2024).select("ticker", F.array_join(F.transform("missing", lambda y: y.cast("string")), ",").alias("missing")), oracle("SELECT ticker, string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) AS missing FROM (SELECT DISTINCT ticker FROM chunk) t, range(2015, 2025) r(y) WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.ticker = t.ticker AND c.form_type = '10-K' AND CAST(c.fiscal_year AS INT) = y) GROUP BY ticker")),
    "metadata_correction": (metadata_correction, CORRECTION),
    "html_tables": (html_tables, "SELECT page_id, CASE k WHEN 0 THEN 'k|' || CAST(page_id AS VARCHAR) ELSE 'v|a b' END AS cells FROM pages, (VALUES (0), (1)) x(k)"),
    "period_summaries": (lambda s, d: al.summaries(al.cluster_quarters(relational._aligned(s, d))), relational.SUMMARIES),
    "speakers": (lambda s, d: tr.question_chunks(view(s, d, "entry").withColumn("speaker", F.initcap("speaker"))).select("conv_id", "group", F.array_join(tr.speakers_of(F.col("text")), ",").alias("speakers")).filter("speakers <> ''").groupBy("speakers").agg(F.count(F.lit(1)).alias("n")), chunk_sql.SPEAKERS),
    "news_key_points": (lambda s, d: nw.key_points(view(s, d, "news").join(view(s, d, "chunk").select(F.col("id").alias("chunk_id"), "content"), "chunk_id"), "content").select("chunk_id", "point"), oracle("WITH r AS (SELECT chunk_id, published, content FROM news JOIN (SELECT id AS chunk_id, content FROM chunk) USING (chunk_id) ORDER BY published DESC, chunk_id LIMIT 10) SELECT chunk_id, trim(split_part(content, '.', 1)) AS point FROM r WHERE length(trim(split_part(content, '.', 1))) > 20 ORDER BY published DESC, chunk_id LIMIT 8")),
    "confidence_level": (lambda s, d: nw.sentiment(view(s, d, "news"), ["company"]).select("company", us.confidence(F.col("confidence")).alias("c")).agg(us.confidence_level(F.avg("c")).alias("level")), oracle("SELECT CASE WHEN avg(c) >= 2.5 THEN 'high' WHEN avg(c) >= 1.5 THEN 'medium' ELSE 'low' END AS level FROM (SELECT CASE WHEN count(*) >= 5 THEN 3 WHEN count(*) >= 2 THEN 2 ELSE 1 END AS c FROM news GROUP BY company)")),
}
