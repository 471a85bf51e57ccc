"""Queries of sources, sinks and streams, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import news as nw
from ..sources import readers, tables
from ..sources.scratch import folder as scratch
from ..streaming import prices as st
from .views import oracle, view


def company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts written as nested JSON, a document a company, and read back."""
    one = F.struct(F.lit(None).cast("date").alias("start"), F.col("period_end_date").alias("end"), F.date_add("period_end_date", 40).alias("filed"), F.lit("10-Q").alias("form"), F.col("period_type").alias("fp"), F.col("fiscal_year").alias("fy"), F.col("total_revenue").cast("double").alias("val"), F.lit(None).cast("string").alias("frame"))
    rows = view(spark, sf_dir, "income").filter("period_length_months = 3").groupBy("cik", "ticker").agg(F.collect_list(one).alias("v"))
    units = F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), F.col("v")).alias("units")))
    folder = scratch(spark)
    rows.select(F.col("cik").cast("string").alias("cik"), F.col("ticker").alias("entityName"), F.struct(units.alias("us-gaap")).alias("facts")).repartition(2).write.option("ignoreNullFields", False).json(folder)
    raw = spark.read.schema(readers.FACTS).json(folder)
    tags = raw.select(readers.padded_cik(F.col("cik")).alias("cik"), F.explode("facts.us-gaap").alias("tag", "body"))
    return tags.select("cik", "tag", F.explode("body.units").alias("unit", "f")).select("cik", "tag", "unit", F.inline("f")).select("cik", "tag", "unit", "end", "filed", "fy", "val")


def ticker_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension = view(spark, sf_dir, "company").select(F.concat(F.lit("s."), F.col("cik").cast("string")).alias("ticker"), "cik")
    n = F.col("cik") * 2  # half of the tickers asked for are of no company
    asked = view(spark, sf_dir, "company").select(F.concat(F.when(F.col("cik") % 2 == 0, F.lit(" s.")).otherwise(F.lit("S-")), n.cast("string")).alias("ticker"))
    return readers.with_cik(asked, dimension)


def price_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "price").select("ticker", "date", "close_price")
    primary = rows.filter("day(date) % 3 <> 0").withColumn("source", F.lit("primary"))
    return readers.with_fallback(primary, rows.filter("day(date) % 2 = 0").withColumn("source", F.lit("backup")), ["ticker", "date"])


def table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written to a table, merged with later ones, and old ones deleted."""
    rows = view(spark, sf_dir, "price").select("ticker", "date", "close_price", "volume")
    table = tables.Table(spark, scratch(spark), "ticker string, date date, close_price double, volume bigint", ["ticker", "date"])
    table.upsert(rows.filter("date <= '2024-01-20'").withColumn("volume", F.lit(0).cast("bigint")))
    table.upsert(rows.filter("date >= '2024-01-10'"))
    table.delete(F.col("date") < F.to_date(F.lit("2024-01-05")))
    return table.read()


def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    table = tables.Table(spark, f"{folder}/bars", st.BAR, ["ticker", "date"])
    st.keep_bars(st.stream(spark, sf_dir), table, f"{folder}/checkpoint").awaitTermination()
    return table.read().drop("first_id", "last_id")


def filing_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("CONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t"), F.date_format("period_end_date", "yyyyMMdd"), F.lit("\nCENTRAL INDEX KEY:\t"), F.col("cik").cast("string"), F.when(F.col("cik") % 2 == 0, "\nFISCAL YEAR END:\t0930").otherwise(""))
    rows = view(spark, sf_dir, "income").filter("period_length_months = 3").select(text.alias("text"))
    return readers.filing_headers(rows).select("cik", "form_type", "period_end", "fiscal_year", "company_name")


QUERIES = {
    "company_facts_json": (company_facts, oracle("SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, 'Revenues' AS tag, 'USD' AS unit, period_end_date AS \"end\", period_end_date + 40 AS filed, fiscal_year AS fy, CAST(total_revenue AS DOUBLE) AS val FROM income WHERE period_length_months = 3")),
    "cik_lookup": (ticker_lookup, oracle("SELECT CASE WHEN a.cik % 2 = 0 THEN ' s.' ELSE 'S-' END || CAST(a.cik * 2 AS VARCHAR) AS ticker, lpad(CAST(b.cik AS VARCHAR), 10, '0') AS cik FROM company a LEFT JOIN company b ON b.cik = a.cik * 2")),
    "price_fallback": (price_fallback, oracle("SELECT ticker, date, close_price, CASE WHEN day(date) % 3 <> 0 THEN 'primary' ELSE 'backup' END AS source FROM price WHERE day(date) % 3 <> 0 OR day(date) % 2 = 0")),
    "table_merge": (table_merge, oracle("SELECT ticker, date, close_price, CASE WHEN date >= DATE '2024-01-10' THEN volume ELSE 0 END AS volume FROM price WHERE date >= DATE '2024-01-05'")),
    "stream_price_bars": (stream_bars, oracle("SELECT ticker, date, open_price, high_price, low_price, close_price, volume FROM price")),
    "filing_headers": (filing_headers, oracle("SELECT lpad(CAST(cik AS VARCHAR), 10, '0') AS cik, '10-K' AS form_type, period_end_date AS period_end, CAST(year(period_end_date) + CASE WHEN cik % 2 = 0 AND strftime(period_end_date, '%m%d') > '0930' THEN 1 ELSE 0 END AS INT) AS fiscal_year, CAST(NULL AS VARCHAR) AS company_name FROM income WHERE period_length_months = 3")),
    "news_queries": (lambda s, d: nw.queries(view(s, d, "news").select("company").distinct(), ["earnings", "products", "legal"]), oracle("SELECT company, category FROM (SELECT DISTINCT company FROM news), (VALUES ('earnings'), ('products'), ('legal')) c(category)")),
    "duplicate_filings": (lambda s, d: view(s, d, "chunk").groupBy("ticker", "form_type", "fiscal_year", "fiscal_quarter").agg(F.count(F.lit(1)).alias("n")), oracle("SELECT ticker, form_type, fiscal_year, fiscal_quarter, count(*) AS n FROM chunk GROUP BY ALL")),
}
