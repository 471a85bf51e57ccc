"""Queries of fiscal calendars, stored LTM rows, tables by partition, landed calls and their structure, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import ASKED_RATIOS, CATEGORY_WORDS, RATIOS
from ..operators import calendars as ca, definitions as de, fundamentals as fu, structure as sr, transcripts as tr
from ..sources import landed_calls as lc
from ..sources.partitioned import Partitioned
from ..sources.scratch import folder
from .views import oracle, view

AT = "2024-06-01 12:00:00"


# calendars ----------------------------------------------------------------------------------------------------------
def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filed facts of all companies, whose years end in all months: a company's is cik % 12 + 1."""
    rows = view(spark, sf_dir, "balance").select("cik", "fiscal_year", F.coalesce(F.substring("fiscal_quarter", 2, 1).cast("int"), (F.col("cik") % 4 + 1).cast("int")).alias("q"), "total_assets")
    month = (F.pmod(F.col("cik") % 12 + 3 * F.col("q"), F.lit(12)) + 1).cast("int")
    end = F.last_day(F.make_date("fiscal_year", month, F.lit(1)))
    return rows.select("cik", F.when(F.col("total_assets").isNull(), "Other").otherwise("Assets").alias("tag"), F.lit("USD").alias("unit"), end.alias("end"), "fiscal_year", F.when(F.col("q") == 4, "FY").otherwise(F.concat(F.lit("Q"), "q")).alias("fp")).withColumnRenamed("fiscal_year", "fy")


def fiscal_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest fact of each company's assets, and the month in which its years end."""
    return ca.latest_info(_assets(spark, sf_dir)).withColumn("end_month", ca.end_month(F.col("end"), F.col("fp")))


def fiscal_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each company's fiscal quarters from its first to its last sale."""
    return _calendar(spark, sf_dir)


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("cik")).agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))
    return ca.calendar(span.join(fiscal_info(spark, sf_dir).select("cik", "end_month"), "cik"), "cik", "end_month", "first", "last")


def fiscal_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales and pieces of every company by its own fiscal quarters; days are summed before they meet the calendar."""
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5).cast("bigint")
    days = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("cik"), F.to_date("l_shipdate").alias("day")).agg(F.sum(cents).alias("sales"), F.count(F.lit(1)).alias("n"))
    return ca.with_quarter(days, _calendar(spark, sf_dir), "cik", "day").groupBy("cik", "fiscal_year", "quarter").agg(F.sum("sales").alias("sales"), F.sum("n").alias("n"))


_INFO = """f AS (SELECT cik, fiscal_year AS fy, coalesce(CAST(substr(fiscal_quarter, 2, 1) AS INT), CAST(cik % 4 + 1 AS INT)) AS q FROM balance WHERE total_assets IS NOT NULL),
g AS (SELECT cik, last_day(make_date(fy, CAST((cik % 12 + 3 * q) % 12 + 1 AS INT), 1)) AS "end", fy, CASE WHEN q = 4 THEN 'FY' ELSE 'Q' || CAST(q AS VARCHAR) END AS fp FROM f),
info AS (SELECT cik, "end", fy, fp, CAST(cik % 12 + 1 AS INT) AS end_month FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY "end" DESC, fy DESC, fp DESC) AS rn FROM g) WHERE rn = 1)"""
_SPANS = """span AS (SELECT l_suppkey AS cik, CAST(min(l_shipdate) AS DATE) AS first, CAST(max(l_shipdate) AS DATE) AS last FROM lineitem GROUP BY l_suppkey),
months AS (SELECT cik, end_month, unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS m FROM span JOIN info USING (cik)),
named AS (SELECT cik, end_month, m, CAST(year(m) + CASE WHEN month(m) > end_month THEN 1 ELSE 0 END AS INT) AS fiscal_year, CAST((month(m) - end_month - 1 + 24) % 12 // 3 + 1 AS INT) AS quarter FROM months)"""
INFO = oracle(f"WITH {_INFO} SELECT * FROM info")
CALENDAR = oracle(f"""WITH {_INFO}, {_SPANS}, k AS (SELECT DISTINCT cik, end_month, fiscal_year, quarter FROM named)
SELECT cik, fiscal_year, quarter, CAST(make_date(fiscal_year, end_month, 1) - to_months(3 * (4 - quarter) + 2) AS DATE) AS start, last_day(CAST(make_date(fiscal_year, end_month, 1) - to_months(3 * (4 - quarter)) AS DATE)) AS "end" FROM k""")
SALES = oracle(f"""WITH {_INFO}, d AS (SELECT l_suppkey AS cik, CAST(l_shipdate AS DATE) AS day, CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT) AS c FROM lineitem)
SELECT cik, CAST(year(day) + CASE WHEN month(day) > end_month THEN 1 ELSE 0 END AS INT) AS fiscal_year, CAST((month(day) - end_month - 1 + 24) % 12 // 3 + 1 AS INT) AS quarter, CAST(sum(c) AS BIGINT) AS sales, count(*) AS n FROM d JOIN info USING (cik) GROUP BY ALL""")


def period_chunks(period: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = view(spark, sf_dir, "chunk")
        quarter = F.col("fiscal_quarter").try_cast("int")
        end = F.last_day(F.make_date(F.col("fiscal_year").cast("int"), F.coalesce(quarter * 3, F.lit(12)), F.lit(1)))
        reports = rows.select("ticker", "form_type", "fiscal_year", "fiscal_quarter", end.alias("period_end_date")).distinct()
        return ca.in_period(rows, reports, period, ["ticker"]).select("id", "ticker", "form_type", "fiscal_year", "fiscal_quarter")

    return run


def _period_sql(wanted: str) -> str:
    return oracle(f"""WITH r AS (SELECT DISTINCT ticker, form_type, fiscal_year, fiscal_quarter, last_day(make_date(CAST(fiscal_year AS INT), coalesce(TRY_CAST(fiscal_quarter AS INT) * 3, 12), 1)) AS d FROM chunk),
n AS (SELECT *, row_number() OVER (PARTITION BY ticker, form_type ORDER BY d DESC, fiscal_year DESC, fiscal_quarter DESC) AS rn FROM r), k AS (SELECT * FROM n WHERE rn = 1 AND form_type = '10-K'), q AS (SELECT * FROM n WHERE rn = 1 AND form_type <> '10-K'),
w AS ({wanted}) SELECT id, ticker, form_type, fiscal_year, fiscal_quarter FROM chunk WHERE (ticker, form_type, fiscal_year, fiscal_quarter) IN (SELECT (ticker, form_type, fiscal_year, fiscal_quarter) FROM w)""")


_ONE = "SELECT k.* FROM k LEFT JOIN q USING (ticker) WHERE q.d IS NULL OR q.d <= k.d UNION ALL SELECT q.* FROM q LEFT JOIN k USING (ticker) WHERE k.d IS NULL OR q.d > k.d"


# stored LTM rows ----------------------------------------------------------------------------------------------------
def ltm_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows of six methods, some calculated more than a day ago, against new ones of other methods."""
    rows = view(spark, sf_dir, "income").filter("period_length_months = 3").select("cik", "period_end_date", "fiscal_year", F.substring("period_type", 2, 1).cast("int").alias("q"), F.col("total_revenue").alias("v"))
    level = lambda n: F.element_at(F.array(*map(F.lit, fu.REPLACING)), (F.pmod(n, F.lit(6)) + 1).cast("int"))
    hours = lambda n: F.to_timestamp(F.lit(AT)) - F.make_dt_interval(hours=(n * 20).cast("int"))
    old = rows.filter("q < 4").select("cik", "period_end_date", level(F.col("cik") + F.col("fiscal_year")).alias("calculation_method"), hours(F.col("cik") % 3).alias("ltm_calculation_date"), "v")
    new = rows.filter("q > 1").select("cik", "period_end_date", level(F.col("cik") + 2 * F.col("q") + F.col("fiscal_year") - 4).alias("calculation_method"), F.lit(None).cast("timestamp").alias("ltm_calculation_date"), (F.col("v") + 1).alias("v"))
    return fu.replaced(old, new, AT).withColumn("hours", ((F.to_timestamp(F.lit(AT)).cast("long") - F.col("ltm_calculation_date").cast("long")) / 3600).cast("int")).drop("ltm_calculation_date")


_LEVEL = "list_extract(['" + "', '".join(fu.REPLACING) + "'], CAST({0} % 6 + 1 AS INT))"
REPLACED = oracle(f"""WITH r AS (SELECT cik, period_end_date, fiscal_year, CAST(substr(period_type, 2, 1) AS INT) AS q, total_revenue AS v FROM income WHERE period_length_months = 3),
o AS (SELECT cik, period_end_date, (cik + fiscal_year) % 6 AS m, {_LEVEL.format("(cik + fiscal_year)")} AS method, CAST(cik % 3 * 20 AS INT) AS hours, v FROM r WHERE q < 4), n AS (SELECT cik, period_end_date, (cik + 2 * q + fiscal_year - 4) % 6 AS m, {_LEVEL.format("(cik + 2 * q + fiscal_year - 4)")} AS method, v + 1 AS v FROM r WHERE q > 1),
j AS (SELECT coalesce(o.cik, n.cik) AS cik, coalesce(o.period_end_date, n.period_end_date) AS period_end_date, n.cik IS NOT NULL AND (o.cik IS NULL OR n.m < o.m OR n.m = o.m AND o.hours > 24) AS takes, o.method AS om, o.hours AS oh, o.v AS ov, n.method AS nm, n.v AS nv FROM o FULL JOIN n ON o.cik = n.cik AND o.period_end_date = n.period_end_date)
SELECT cik, period_end_date, CASE WHEN takes THEN nm ELSE om END AS calculation_method, CASE WHEN takes THEN nv ELSE ov END AS v, CAST(CASE WHEN takes THEN 0 ELSE oh END AS INT) AS hours FROM j""")


# tables by partition ------------------------------------------------------------------------------------------------
def day_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in a table by day; the volumes of the last days are written again, and one day comes in."""
    rows = view(spark, sf_dir, "price").select("ticker", "close_price", "volume", "date")
    days = Partitioned(spark, folder(spark), "ticker string, close_price double, volume bigint, date date", ["ticker", "date"], "date")
    days.upsert(rows.filter("date < '2024-01-28'"))
    days.upsert(rows.filter("date >= '2024-01-25'").withColumn("volume", F.col("volume") + 1))
    return days.read()


# calls --------------------------------------------------------------------------------------------------------------
def landed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns landed as JSON by company and year, read through the data source of calls with filters on both."""
    at = F.col("conv_id") % 24
    rows = view(spark, sf_dir, "entry").select(F.concat(F.lit("K"), F.floor(F.col("conv_id") / 96).cast("string")).alias("ticker"), (2018 + F.floor(at / 4)).cast("int").alias("fiscal_year"), (at % 4 + 1).cast("int").alias("quarter"), "seq", "speaker", "content")
    path = folder(spark)
    rows.repartition("ticker", "fiscal_year").write.partitionBy("ticker", "fiscal_year").json(path)
    lc.register(spark)
    found = spark.read.format("landed_calls").load(path).filter("fiscal_year >= 2020 and fiscal_year <> 2022")
    return found.groupBy("ticker", "fiscal_year", "quarter", "speaker").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"))


LANDED = oracle("""SELECT 'K' || CAST(conv_id // 96 AS VARCHAR) AS ticker, CAST(2018 + conv_id % 24 // 4 AS INT) AS fiscal_year, CAST(conv_id % 24 % 4 + 1 AS INT) AS quarter, speaker, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars
FROM entry WHERE conv_id % 24 // 4 >= 2 AND conv_id % 24 // 4 <> 4 GROUP BY ALL""")


def _raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as the raw text of a call: an analyst's and a manager's turns, some of whom have no title."""
    who = F.when(F.col("speaker") == "user", F.when(F.col("conv_id") % 5 == 0, "Ann Lee").otherwise("Ann Lee (Analyst, First Bank)")).otherwise(F.when(F.col("seq") % 4 == 1, "Bob Ray (CFO)").otherwise("Bob Ray"))
    rows = view(spark, sf_dir, "entry").filter("seq > 0 or conv_id % 3 > 0").select("conv_id", F.struct("seq", F.concat(who, F.lit(": "), "content").alias("line")).alias("s"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["line"]), "\n\n").alias("raw"))


def call_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all calls from their raw text: text, number of turns, titles by speaker."""
    return sr.sections(sr.turns(_raw_calls(spark, sf_dir), "conv_id", "raw"), "conv_id").select("conv_id", "section", F.md5("text").alias("text_md5"), "turns", F.to_json("titles").alias("titles"))


def call_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sr.records(sr.turns(_raw_calls(spark, sf_dir), "conv_id", "raw"), "conv_id").select("conv_id", F.array_join("participants", ",").alias("participants"), "turns", F.md5("text").alias("text_md5"))


_STRUCTURE = r"""t AS (SELECT conv_id, seq, CASE WHEN speaker = 'user' THEN 'Ann Lee' ELSE 'Bob Ray' END AS speaker, CASE WHEN speaker = 'user' THEN CASE WHEN conv_id % 5 <> 0 THEN 'Analyst, First Bank' END WHEN seq % 4 = 1 THEN 'CFO' END AS title,
array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), ' ') AS content FROM entry WHERE seq > 0 OR conv_id % 3 > 0),
s AS (SELECT *, CASE WHEN max(CASE WHEN title LIKE 'Analyst%' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 THEN 'Q&A Session' ELSE 'Opening Remarks' END AS section FROM t),
x AS (SELECT conv_id, section, string_agg(speaker || ': ' || content, chr(10) ORDER BY seq) AS text, count(*) AS turns, arg_min(title, seq) FILTER (speaker = 'Ann Lee' AND title IS NOT NULL) AS ann, count(*) FILTER (speaker = 'Ann Lee') AS anns, arg_min(title, seq) FILTER (speaker = 'Bob Ray' AND title IS NOT NULL) AS bob, count(*) FILTER (speaker = 'Bob Ray') AS bobs FROM s GROUP BY ALL)"""
STRUCTURE = oracle(f"""WITH {_STRUCTURE} SELECT conv_id, section, md5(text) AS text_md5, turns, '{{' || concat_ws(',', CASE WHEN anns > 0 THEN '"Ann Lee":"' || coalesce(ann, '') || '"' END, CASE WHEN bobs > 0 THEN '"Bob Ray":"' || coalesce(bob, '') || '"' END) || '}}' AS titles FROM x""").replace("{{", "{").replace("}}", "}")
RECORDS = oracle(f"""WITH {_STRUCTURE}, p AS (SELECT conv_id, string_agg(speaker, ',' ORDER BY f) AS participants FROM (SELECT conv_id, speaker, min(seq) AS f FROM s GROUP BY ALL) GROUP BY conv_id)
SELECT conv_id, participants, CAST(sum(turns) AS BIGINT) AS turns, md5(string_agg(upper(section) || chr(10) || repeat('-', length(section)) || chr(10) || text, chr(10) || chr(10) ORDER BY section)) AS text_md5 FROM x JOIN p USING (conv_id) GROUP BY conv_id, participants""")

#: What the calls of one in seven companies say, put in by key.
SAID = ("we beat consensus", "they were disappointed", "raising our full year guidance", "we cut the outlook", "a new product", "an alliance and a merger", "")


def call_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "entry")
    said = F.element_at(F.array(*map(F.lit, SAID)), ((F.col("conv_id") + F.col("seq")) % len(SAID) + 1).cast("int"))
    return tr.insights(rows.withColumn("content", F.concat("content", F.lit("\nWell, "), said)))


_FLAGS = ", ".join(f"bool_or(regexp_matches(low, '{p}')) AS {n}" for n, p in tr.INSIGHTS.items())
CALL_INSIGHTS = oracle(f"WITH l AS (SELECT conv_id, lower(content || chr(10) || 'Well, ' || list_extract({list(SAID)}, CAST((conv_id + seq) % {len(SAID)} + 1 AS INT))) AS low FROM entry) SELECT conv_id, {_FLAGS} FROM l GROUP BY conv_id")


#: Names of the catalog, other names, and names of no ratio that is known.
ASKS = ["ROE", "Cash Ratio", "Revenue_Growth_YoY", *(n for own in ASKED_RATIOS.values() for n in own), "quick look", "days of debt", "price level", "no such ratio"]


def asked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the four ratios that every company asks for."""
    picked = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.element_at(F.array(*map(F.lit, ASKS)), (F.pmod(F.col("cik") * (j + 1) + j * 11, F.lit(len(ASKS))) + 1).cast("int")))
    return de.categories_asked(view(spark, sf_dir, "company").select("cik", picked.alias("ratios")), ["cik"]).select("cik", F.array_join("categories", ",").alias("categories"))


_KNOWN = ", ".join(f"('{n}', '{c}')" for n, c in ({n.lower(): c for n, c, _ in RATIOS} | {n: c for c, own in ASKED_RATIOS.items() for n in own}).items())
_GUESS = "CASE " + " ".join(f"WHEN regexp_matches(n, '{'|'.join(words)}') THEN '{c}'" for c, words in CATEGORY_WORDS.items()) + " ELSE 'profitability' END"
ASKED_FOR = oracle(f"""WITH a AS (SELECT cik, translate(lower(list_extract({ASKS}, CAST((cik * (j + 1) + j * 11) % {len(ASKS)} + 1 AS INT))), ' -', '__') AS n FROM company, range(0, 4) t(j)), k(n, c) AS (VALUES {_KNOWN})
SELECT cik, string_agg(DISTINCT coalesce(c, {_GUESS}), ',' ORDER BY coalesce(c, {_GUESS})) AS categories FROM a LEFT JOIN k USING (n) GROUP BY cik""")

QUERIES = {
    "call_insights": (call_insights, CALL_INSIGHTS),
    "asked_categories": (asked_categories, ASKED_FOR),
    "fiscal_info": (fiscal_info, INFO),
    "fiscal_calendar": (fiscal_calendar, CALENDAR),
    "fiscal_sales": (fiscal_sales, SALES),
    "chunks_latest": (period_chunks("latest"), _period_sql(_ONE)),
    "chunks_latest_both": (period_chunks("latest_10k_and_10q"), _period_sql("SELECT * FROM k UNION ALL SELECT * FROM q")),
    "chunks_latest_quarter": (period_chunks("latest_10q"), _period_sql("SELECT * FROM q")),
    "ltm_replaced": (ltm_replaced, REPLACED),
    "day_merge": (day_merge, oracle("SELECT ticker, close_price, CASE WHEN date >= DATE '2024-01-25' THEN volume + 1 ELSE volume END AS volume, date FROM price")),
    "landed_calls": (landed_calls, LANDED),
    "call_structure": (call_structure, STRUCTURE),
    "call_records": (call_records, RECORDS),
}
