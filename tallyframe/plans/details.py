"""Queries of smaller operators, each over whole tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import period, text as tx
from ..functions.catalog import RATIOS, VIRTUAL
from ..functions.synonyms import NARRATIVE, NARRATIVE_CUES, PHRASES, SYNONYMS
from ..operators import chunks as ch, definitions as de, facts, filings as fi, fundamentals as fu, news as nw, prices as pr, relational as re_, search as se, summaries as su, transcripts as tr
from . import chunk_sql, fundamentals, relational, retrieval
from .views import oracle, shared, view

AT = "2024-06-01 12:00:00"


# periods and statements -----------------------------------------------------------------------------------------------
def _of_statements(text: str):
    return lambda spark, sf_dir: period.of_statements(relational._statements(spark, sf_dir), text)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio periods of which a third of the companies has no Q4 label, and a third no label of a quarter or year at all."""
    rows = view(spark, sf_dir, "income").filter("period_length_months in (3, 12)")
    kind = F.when(F.col("cik") % 3 == 2, F.lit("LTM")).otherwise(F.col("period_type"))
    quarter = F.when((F.col("cik") % 3 == 0) & (F.col("period_type") != "FY"), F.col("period_type"))
    return rows.select("cik", "period_end_date", "fiscal_year", kind.alias("period_type"), quarter.alias("fiscal_quarter"), "total_revenue").distinct()


_LABELLED = "lab AS (SELECT DISTINCT cik, period_end_date, fiscal_year, CASE WHEN cik % 3 = 2 THEN 'LTM' ELSE period_type END AS period_type, CASE WHEN cik % 3 = 0 AND period_type <> 'FY' THEN period_type END AS fiscal_quarter, total_revenue FROM income WHERE period_length_months IN (3, 12))"
LADDER = oracle(f"""WITH {_LABELLED}, w AS (SELECT *, coalesce(fiscal_quarter = 'Q4', false) AS q4, period_type = 'FY' AS fy, period_end_date = max(period_end_date) OVER (PARTITION BY cik, fiscal_year) AS latest FROM lab),
x AS (SELECT *, CASE WHEN bool_or(q4) OVER (PARTITION BY cik) THEN q4 WHEN bool_or(fy) OVER (PARTITION BY cik) THEN fy ELSE latest END AS way FROM w),
y AS (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY fiscal_year DESC) AS k FROM x WHERE way) SELECT cik, period_end_date, fiscal_year, period_type, fiscal_quarter, total_revenue FROM y WHERE k <= 2""")

PRIORITY = ["ticker", "period_end_date", "period_type", "data_source", "statement_type", "fiscal_year"]
TECHNICAL = ["id", "company_id", "created_at", "updated_at", "calculation_date"]


def ordered_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies' statements, tickers ascending and dates descending; leading columns first, the others by name, technical ones left out."""
    rows = view(spark, sf_dir, "cash_flow").withColumns({"id": F.lit(0), "created_at": F.lit(AT)})
    columns = [c for c in PRIORITY if c in rows.columns] + sorted(c for c in rows.columns if c not in PRIORITY and c not in TECHNICAL)
    return rows.select(*columns).orderBy("ticker", F.desc("period_end_date"), "period_length_months")


def ltm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest LTM rows of one ticker, a fixed number of them."""
    ticker = view(spark, sf_dir, "company").filter("cik = 1").select("ticker")
    return fu.ltm(shared(spark, sf_dir, "income").join(F.broadcast(ticker), "ticker", "left_semi")).select("ticker", "period_end_date", "calculation_method", "total_revenue").orderBy(F.desc("period_end_date"), "calculation_method").limit(6)


def statement_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [view(spark, sf_dir, n).select("cik", "fiscal_year", F.lit(n).alias("statement_type")) for n in ("income", "cash_flow", "balance")]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("cik", "fiscal_year").agg(F.count_distinct("statement_type").alias("kinds"))


def raw_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of filed facts for lengths asked for; every fact is filed a second time with half its length."""
    fact = fundamentals._fact(spark, sf_dir)
    rows = fact.unionByName(fact.withColumns({"start": F.date_sub("end", 92), "val": F.col("val") + 1}))
    asked = fact.filter("filed is not null").select("cik", "tag", "end", "filed", F.when(F.col("fp") == "FY", 12).otherwise(3).alias("months")).distinct()
    return facts.value_at(rows, asked)


RAW = fundamentals._fact_oracle("""SELECT cik, tag, "end", filed, months, val FROM (SELECT a.*, f.val, row_number() OVER (PARTITION BY a.cik, a.tag, a."end", a.filed, a.months ORDER BY list_position(['USD', 'shares', 'pure', 'USD/shares'], unit), coalesce(abs(round(date_diff('day', start, f."end") / 30.44) - a.months) > 1, true), coalesce(start, DATE '0001-01-01'), val) AS rn
FROM (SELECT DISTINCT cik, tag, "end", filed, CASE WHEN fp = 'FY' THEN 12 ELSE 3 END AS months FROM fact WHERE filed IS NOT NULL) a JOIN (SELECT * FROM fact UNION ALL SELECT cik, tag, unit, CAST("end" - 92 AS DATE), "end", filed, fp, fy, val + 1 FROM fact) f USING (cik, tag, "end", filed) WHERE unit IN ('USD', 'shares', 'pure', 'USD/shares') AND val IS NOT NULL) WHERE rn = 1""").replace("mapped AS", "mapped_ AS")


# definitions --------------------------------------------------------------------------------------------------------
def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common definitions, and for every company own ones of a fifth of the names."""
    common = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), F.lit(f).alias("formula"), F.lit(k).alias("k")) for k, (n, c, f) in enumerate(RATIOS)))
    own = view(spark, sf_dir, "company").select(F.col("cik").cast("bigint").alias("company_id"), F.inline(common)).filter("(company_id + k) % 5 = 0")
    own = own.select("company_id", "name", "category", F.concat(F.col("company_id").cast("string"), F.lit(" * ("), "formula", F.lit(")")).alias("formula"))
    names = spark.createDataFrame([(None, n, c, f) for n, c, f in RATIOS], "company_id bigint, name string, category string, formula string")
    return own.unionByName(names).withColumns({"active": F.lit(True), "updated_at": F.lit(None).cast("timestamp")})


_NAMED = "names AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{c}', '{f}', {k})" for k, (n, c, f) in enumerate(RATIOS)) + ") x(name, category, formula, k))"
_DEFS = f"{_NAMED}, defs AS (SELECT CAST(cik AS BIGINT) AS company_id, n.name, n.category, CAST(cik AS VARCHAR) || ' * (' || formula || ')' AS formula FROM company, names n WHERE (cik + k) % 5 = 0 UNION ALL SELECT NULL, name, category, formula FROM names)"


def definitions_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All companies' definitions after a change, a soft deletion, an export and an import."""
    rows = _definitions(spark, sf_dir)
    changes = rows.filter("category = 'liquidity'").select("company_id", "name", F.lit(None).cast("string").alias("category"), F.concat(F.lit("1 * "), "formula").alias("formula"))
    state = de.retired(de.updated(rows, changes, AT), rows.filter("category = 'growth'"), AT)
    return de.imported(de.exported(state), AT).select("company_id", "name", "category", "formula", "active")


def formula_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of every company that differ from the catalogue's, and names that it lacks."""
    rows = _definitions(spark, sf_dir)
    stored = rows.filter("company_id is not null").select("company_id", F.col("name").alias("ratio_name"), F.when(F.col("company_id") % 2 == 0, F.regexp_extract("formula", r"\((.*)\)$", 1)).otherwise(F.col("formula")).alias("formula"))
    common = F.array(*(F.struct(F.lit(n).alias("ratio_name"), F.lit(f).alias("formula")) for n, _, f in RATIOS))
    catalog = view(spark, sf_dir, "company").select(F.col("cik").cast("bigint").alias("company_id"), F.inline(common))
    return su.drift(catalog, stored, ["company_id", "ratio_name"])


def used_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = su.nested(fu.ratios(fundamentals._periods(spark, sf_dir), RATIOS, VIRTUAL, False), ["cik", "period_end_date"])
    return de.used_in(reports, _definitions(spark, sf_dir).filter("company_id is null"), ["cik", "period_end_date"])


USED = oracle(f"WITH {fundamentals._PERIODS}, {fundamentals._virtual_sql()}, long_ AS ({fundamentals._ratio_sql()}), {_NAMED}, u AS (SELECT ratio_name AS name, count(DISTINCT (cik, period_end_date)) AS reports FROM long_ WHERE v IS NOT NULL GROUP BY ratio_name) SELECT name, reports, category, formula FROM u JOIN names USING (name)")


# state --------------------------------------------------------------------------------------------------------------
def company_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each company when those of one region are reset."""
    gone = view(spark, sf_dir, "company").filter("sector = 'ASIA'")
    return re_.reset(view(spark, sf_dir, "income"), gone).groupBy("cik").agg(F.count(F.lit(1)).alias("n"))


def updated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written again, some of them changed: only these get a new time."""
    old = view(spark, sf_dir, "price").select("ticker", "date", "volume").withColumn("updated_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    new = old.drop("updated_at").filter("day(date) > 10").withColumn("volume", F.when(F.dayofmonth("date") > 20, F.col("volume") + 1).otherwise(F.col("volume")))
    return re_.touched(old, new, ["ticker", "date"], AT).select("ticker", "date", "volume", (F.col("updated_at") == F.to_timestamp(F.lit(AT))).alias("new"))


def load_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.createDataFrame([], "cik bigint, kind string, n bigint, loaded_at timestamp")
    for name in ("income", "cash_flow", "income"):
        log = re_.audit(log, ["cik"], view(spark, sf_dir, name).withColumn("cik", F.col("cik").cast("bigint")), name, AT)
    return log.select("cik", "kind", "n")


def quarter_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.col("fiscal_year").cast("string"), "period_type")
    rows = view(spark, sf_dir, "income").filter("period_length_months = 3").select("cik", label.alias("quarter"), "fiscal_year")
    state = rows.filter("fiscal_year < 1996").groupBy("cik").agg(F.collect_set("quarter").alias("quarters"))
    return re_.tracked(state, rows.filter("fiscal_year >= 1995"), "cik").select("cik", F.array_join("quarters", ",").alias("quarters"))


# filings ------------------------------------------------------------------------------------------------------------
def filing_storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.storage(view(spark, sf_dir, "chunk"), "form_type", "n_chars", "fiscal_year")


def old_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "chunk").select("id", F.make_date(F.col("fiscal_year").cast("int"), F.lit(1), F.lit(1)).alias("filed"))
    return fi.older(rows, 5, "2023-06-30", "filed")


def new_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "chunk").withColumn("fiscal_quarter", F.nullif("fiscal_quarter", F.lit("FY")))
    return fi.new_chunks(rows, rows.filter("fiscal_year < '2019' or section_name = 'en' and n_chars > 3000")).select("id", "ticker")


def missing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fi.missing_reports(view(spark, sf_dir, "chunk"), 2014, 2020)


def filing_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths and texts of four forms: name, folder, text, none."""
    c, t = F.col("cik"), F.lower("ticker")
    name = F.when(c % 4 == 0, F.concat(F.lit("/data/x1/"), F.translate(F.substring((c + 1000).cast("string"), 2, 3), "0123456789", "abcdefghij"), F.lit("-10k.txt")))
    path = name.when(c % 4 == 1, F.concat(F.lit("/archive0/"), F.translate(F.substring((c + 1000).cast("string"), 2, 3), "0123456789", "ABCDEFGHIJ"), F.lit("/2020filing.txt"))).otherwise("/archive0/2020filing.txt")
    text = F.when(c % 4 == 2, F.concat(F.lit("Common stock. Trading Symbol: "), F.upper(F.translate(F.substring((c + 1000).cast("string"), 2, 3), "0123456789", "klmnopqrst")), F.lit(" on file"))).otherwise(F.concat(F.lit("nothing of "), t))
    return view(spark, sf_dir, "company").select("cik", fi.ticker_of(path, text).alias("found"))


def statement_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fundamentals._fact(spark, sf_dir).select("tag", fi.statement_of_tag(F.col("tag")).alias("statement_type")).groupBy("tag", "statement_type").agg(F.count(F.lit(1)).alias("n"))


def _call_chunks(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        said = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.initcap("speaker"), F.lit(": "), F.col("content")).alias("t"))))
        calls = view(spark, sf_dir, "entry").groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["t"]), "\n").alias("text"))  # a call is one document
        return make(calls, "conv_id", "text").select(F.col("id").alias("conv_id"), "seq", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))

    return run


# text, search, news ---------------------------------------------------------------------------------------------------
def call_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length and number of words of turns, and the shares of analysts and management."""
    rows = view(spark, sf_dir, "entry")
    mean = lambda c: fu.rounded(F.sum(c) / F.count(F.lit(1)), 4)
    return rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), mean(F.length("content")).alias("mean_length"), mean(F.size(tx.tokens(F.col("content")))).alias("mean_words"), mean(F.col("is_analyst")).alias("analysts"))


def call_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each section of a call, its speakers, and how many turns each has."""

    rows = tr.split_at_first_analyst(view(spark, sf_dir, "entry"))
    said = F.array_sort(F.collect_list(F.struct("seq", F.concat("speaker", F.lit(": "), "content").alias("t"))))
    sections = rows.groupBy("conv_id", "section").agg(F.md5(F.array_join(F.transform(said, lambda x: x["t"]), "\n")).alias("text_md5"))
    turns = rows.groupBy("conv_id", "section", "speaker").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id", "section").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "n"))))).alias("turns"))
    return sections.join(turns, ["conv_id", "section"])


def money_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").filter("period_type = 'FY'")
    return rows.select("cik", "fiscal_year", tx.money(F.col("net_income") / 100.0).alias("amount"), tx.percent(F.col("net_income") / F.when(F.col("total_revenue") != 0, F.col("total_revenue"))).alias("share"))


_AMOUNT = "CAST(net_income AS DOUBLE) / 100.0"
_SHORT = lambda unit, letter: f"printf('%.1f', floor(abs({_AMOUNT}) / {unit} * 10.0 + 0.5) / 10.0) || '{letter}'"
MONEY = oracle(f"""SELECT cik, fiscal_year, CASE WHEN net_income IS NULL THEN 'N/A' ELSE CASE WHEN net_income < 0 THEN '-' ELSE '' END || '$' || CASE WHEN abs({_AMOUNT}) >= 1e12 THEN {_SHORT("1e12", "T")} WHEN abs({_AMOUNT}) >= 1e9 THEN {_SHORT("1e9", "B")} WHEN abs({_AMOUNT}) >= 1e6 THEN {_SHORT("1e6", "M")} WHEN abs({_AMOUNT}) >= 1e3 THEN {_SHORT("1e3", "K")} ELSE printf('%.2f', floor(abs({_AMOUNT}) * 100.0 + 0.5) / 100.0) END END AS amount,
CASE WHEN net_income IS NULL OR total_revenue IS NULL OR total_revenue = 0 THEN 'N/A' ELSE printf('%.1f', floor(CAST(net_income AS DOUBLE) / total_revenue * 100.0 * 10.0 + 0.5) / 10.0) || '%' END AS share FROM income WHERE period_type = 'FY'""")


def ratio_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("Net_Margin_"), F.when(F.col("period_type") == "FY", F.concat("period_type", F.col("fiscal_year").cast("string"))).when(F.col("cik") % 2 == 0, F.concat("period_type", F.lit("-"), F.col("fiscal_year").cast("string"))).otherwise("latest"))
    name, at = tx.ratio_key(F.col("key"))
    return view(spark, sf_dir, "income").select(key.alias("key")).distinct().select("key", name.alias("name"), at.alias("period"))


KEYS = oracle(r"SELECT key, regexp_replace(key, '_(?:Q[1-4]-|FY)[0-9][0-9][0-9][0-9]$', '') AS name, nullif(regexp_extract(key, '_((?:Q[1-4]-|FY)[0-9][0-9][0-9][0-9])$', 1), '') AS period FROM (SELECT DISTINCT 'Net_Margin_' || CASE WHEN period_type = 'FY' THEN 'FY' || CAST(fiscal_year AS VARCHAR) WHEN cik % 2 = 0 THEN period_type || '-' || CAST(fiscal_year AS VARCHAR) ELSE 'latest' END AS key FROM income)")


def spoken_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").filter("period_type <> 'FY'")
    said = F.concat(F.lit("For the "), F.element_at(F.create_map(F.lit(3), F.lit("three"), F.lit(6), F.lit("Six"), F.lit(9), F.lit("nine"), F.lit(12), F.lit("twelve")), F.col("period_length_months")), F.lit(" Months  Ended "), F.col("period_end_date").cast("string"), F.when(F.col("cik") % 3 == 0, " and the six months ended").otherwise(""))
    return rows.select("cik", "period_end_date", "period_length_months", tx.quarter_spoken(said).alias("quarter"), F.date_sub("period_end_date", 364).alias("year_start"))


SPOKEN = oracle("SELECT cik, period_end_date, period_length_months, CASE WHEN period_length_months = 9 THEN 3 WHEN period_length_months = 6 OR cik % 3 = 0 THEN 2 ELSE 1 END AS quarter, CAST(period_end_date - 364 AS DATE) AS year_start FROM income WHERE period_type <> 'FY'")


def metadata_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata written as JSON and parsed again."""
    rows = view(spark, sf_dir, "chunk").select("id", F.to_json(F.struct("ticker", "form_type", "fiscal_year")).alias("metadata"))
    return rows.select("id", F.from_json("metadata", "struct<ticker: string, form_type: string, fiscal_year: string>").alias("m")).select("id", "m.*")


HEADS = list(SYNONYMS)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms of the table for each turn of a conversation, some of them phrases."""
    heads = F.array(*map(F.lit, HEADS))
    pick = lambda c: F.element_at(heads, (c % len(HEADS) + 1).cast("int"))
    rows = view(spark, sf_dir, "entry")
    return rows.select("conv_id", "seq", F.concat(pick(F.col("conv_id") * 7 + F.col("seq")), F.lit(" and "), pick(F.col("conv_id") + F.col("seq") * 11), F.when(F.col("seq") == 1, " net income").otherwise("")).alias("query"))


_HEADS = "[" + ", ".join(f"'{h}'" for h in HEADS) + "]"
_QUERIES = f"q AS (SELECT conv_id, seq, {_HEADS}[(conv_id * 7 + seq) % {len(HEADS)} + 1] || ' and ' || {_HEADS}[(conv_id + seq * 11) % {len(HEADS)} + 1] || CASE WHEN seq = 1 THEN ' net income' ELSE '' END AS query FROM entry)"
_TABLE = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{h}', {k}, '{o}')" for h, others in SYNONYMS.items() for k, o in enumerate([h, *others])) + ") s(head, k, name))"
_PHRASES = "phr AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{h}')" for p, h in PHRASES.items()) + ") p(pattern, head))"
_WORDS = r"w AS (SELECT DISTINCT query, unnest(regexp_extract_all(lower(query), '\b(\w+)\b', 1)) AS word FROM q)"
EXPANSION = oracle(rf"""WITH {_QUERIES}, {_TABLE}, {_PHRASES}, {_WORDS}, h AS (SELECT DISTINCT query, head FROM w JOIN syn ON word = lower(name) AND regexp_full_match(name, '\w+') UNION SELECT DISTINCT query, head FROM q JOIN phr ON regexp_matches(lower(query), pattern)),
e AS (SELECT DISTINCT query, name FROM h JOIN syn USING (head) WHERE k BETWEEN 1 AND 2 AND NOT EXISTS (SELECT 1 FROM w WHERE w.query = h.query AND w.word = syn.name)), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY name) AS n FROM e),
x AS (SELECT query, string_agg(name, ' ' ORDER BY n) AS more FROM r WHERE n <= 6 GROUP BY query) SELECT conv_id, seq, query, query || coalesce(' ' || more, '') AS expanded, query || CASE WHEN regexp_matches(lower(query), '{"|".join(NARRATIVE_CUES)}') THEN ' {NARRATIVE}' ELSE '' END AS narrative FROM q LEFT JOIN x USING (query)""")
SUGGESTIONS = oracle(rf"WITH {_QUERIES}, {_TABLE}, {_WORDS} SELECT DISTINCT query, word, head AS term, (SELECT string_agg(name, ',' ORDER BY k) FROM syn t WHERE t.head = s.head AND k BETWEEN 1 AND 5) AS synonyms FROM w JOIN syn s ON word = lower(name) AND regexp_full_match(name, '\w+')")


def metadata_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of two quarters of different years, not of both quarters in both years."""
    rows = view(spark, sf_dir, "chunk")
    return rows.filter(se.where(se.periods_of(["Q1 2016", "2 2019"]), rows.columns)).select("id", "fiscal_year", "fiscal_quarter")


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five different sources of each company."""
    rows = view(spark, sf_dir, "news").select("company", tx.domain(F.col("source_url")).alias("source")).distinct()
    first = rows.withColumn("_r", F.row_number().over(se.Window.partitionBy("company").orderBy("source"))).filter("_r <= 5")
    return first.groupBy("company").agg(F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"))


def prices_by_ticker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "price")
    return rows.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("volume").alias("volume"), F.count_if(F.col("date").between("2024-01-05", "2024-01-20")).alias("inside"))


def adjusted_close(spark: SparkSession, sf_dir: str) -> DataFrame:

    rows = view(spark, sf_dir, "price").withColumn("adjusted_close", F.when(F.dayofmonth("date") % 3 != 0, F.col("close_price") * 2))
    return pr.cleaned(rows).select("ticker", "date", "adjusted_close")


_BM25_ALL = retrieval._BM25.replace(" WHERE section_name = 'en'", "")
_C = "SELECT n_chars, id, ticker, form_type, fiscal_year, nullif(fiscal_quarter, 'FY') AS fiscal_quarter, section_name FROM chunk"
QUERIES = {
    "period_filter_years_ladder": (lambda s, d: period.of_ratios(_labelled(s, d), "last 2 financial years"), LADDER),
    "statements_year": (_of_statements("FY2001"), oracle(f"WITH {relational._ST}, own AS (SELECT * FROM st WHERE period_type = 'FY' AND fiscal_year = 2001 AND data_source <> 'LTM') SELECT * FROM own UNION ALL SELECT * FROM st WHERE data_source = 'LTM' AND (cik, period_end_date) IN (SELECT (cik, period_end_date) FROM own)")),
    "statements_last_quarters": (_of_statements("last 5 quarters"), oracle(f"WITH {relational._ST} SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY period_end_date DESC) AS k FROM st WHERE data_source = 'LTM') WHERE k <= 5")),
    "statements_last_years": (_of_statements("last 2 financial years"), oracle(f"WITH {relational._ST} SELECT * EXCLUDE (k) FROM (SELECT *, dense_rank() OVER (PARTITION BY cik ORDER BY period_end_date DESC) AS k FROM st WHERE period_type = 'FY' AND data_source <> 'LTM') WHERE k <= 2")),
    "ordered_frame": (ordered_frame, oracle("SELECT * FROM cash_flow")),
    "ltm_scan": (ltm_scan, oracle(f"WITH {fundamentals._LTM_INCOME} SELECT ticker, period_end_date, calculation_method, total_revenue FROM ltm_ WHERE cik = 1 ORDER BY period_end_date DESC, calculation_method LIMIT 6")),
    "ltm_subset": (lambda s, d: relational._statements(s, d).filter("data_source = 'LTM'").select("cik", "period_end_date", "total_revenue"), oracle(f"WITH {relational._ST} SELECT cik, period_end_date, total_revenue FROM st WHERE data_source = 'LTM'")),
    "statement_kinds": (statement_kinds, oracle("SELECT cik, fiscal_year, count(DISTINCT t) AS kinds FROM (SELECT cik, fiscal_year, 'i' AS t FROM income UNION ALL SELECT cik, fiscal_year, 'c' FROM cash_flow UNION ALL SELECT cik, fiscal_year, 'b' FROM balance) GROUP BY ALL")),
    "raw_value": (raw_value, RAW),
    "definitions_state": (definitions_state, oracle(f"WITH {_DEFS} SELECT company_id, name, category, CASE WHEN category = 'liquidity' THEN '1 * ' || formula ELSE formula END AS formula, true AS active FROM defs WHERE category <> 'growth'")),
    "formula_drift": (formula_drift, oracle(f"WITH {_NAMED} SELECT CAST(cik AS BIGINT) AS company_id, n.name AS ratio_name, formula AS wanted, CASE WHEN (cik + k) % 5 = 0 THEN CAST(cik AS VARCHAR) || ' * (' || formula || ')' END AS found FROM company, names n WHERE (cik + k) % 5 <> 0 OR cik % 2 = 1")),
    "ratio_categories": (lambda s, d: de.categories(_definitions(s, d)).select("category", "n", F.array_join("names", ",").alias("names")), oracle(f"WITH {_DEFS} SELECT category, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM defs GROUP BY category")),
    "used_definitions": (used_definitions, USED),
    "reverse_mapping": (lambda s, d: de.tags_of_columns(fundamentals._fact(s, d)).select("column", F.array_join("tags", ",").alias("tags")), fundamentals._fact_oracle("""SELECT "column", string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM (SELECT tag, CASE WHEN lower(tag) IN ('revenues', 'salesrevenuenet') THEN 'total_revenue' WHEN tag = 'CostOfRevenue' THEN 'cost_of_revenue' WHEN tag = 'NetIncomeLoss' THEN 'net_income' END AS "column" FROM fact WHERE tag <> 'UnknownTag') GROUP BY "column" """)),
    "company_reset": (company_reset, oracle("SELECT cik, count(*) AS n FROM income WHERE cik NOT IN (SELECT cik FROM company WHERE sector = 'ASIA') GROUP BY cik")),
    "updated_rows": (updated_rows, oracle("SELECT ticker, date, CASE WHEN day(date) > 20 THEN volume + 1 ELSE volume END AS volume, day(date) > 20 AS new FROM price")),
    "load_audit": (load_audit, oracle("SELECT cik, 'income' AS kind, count(*) AS n FROM income GROUP BY cik UNION ALL SELECT cik, 'cash_flow', count(*) FROM cash_flow GROUP BY cik")),
    "quarter_tracker": (quarter_tracker, oracle("SELECT cik, string_agg(q, ',' ORDER BY q) AS quarters FROM (SELECT DISTINCT cik, CAST(fiscal_year AS VARCHAR) || period_type AS q FROM income WHERE period_length_months = 3) GROUP BY cik")),
    "filing_storage": (filing_storage, oracle("SELECT form_type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, min(fiscal_year) AS first, max(fiscal_year) AS last FROM chunk GROUP BY form_type")),
    "old_filings": (old_filings, oracle("SELECT id, make_date(CAST(fiscal_year AS INT), 1, 1) AS filed FROM chunk WHERE make_date(CAST(fiscal_year AS INT), 1, 1) < DATE '2018-06-30'")),
    "new_filings": (new_filings, oracle(f"WITH c AS ({_C}) SELECT id, ticker FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE (x.fiscal_year < '2019' OR x.section_name = 'en' AND x.n_chars > 3000) AND x.ticker IS NOT DISTINCT FROM c.ticker AND x.form_type = c.form_type AND x.fiscal_year = c.fiscal_year AND x.fiscal_quarter IS NOT DISTINCT FROM c.fiscal_quarter)")),
    "missing_reports": (missing_reports, oracle("WITH t AS (SELECT DISTINCT ticker FROM chunk), e AS (SELECT ticker, '10-K' AS form_type, CAST(y AS INT) AS fiscal_year, 'FY' AS fiscal_quarter FROM t, range(2014, 2021) r(y) UNION ALL SELECT ticker, '10-Q', CAST(y AS INT), q FROM t, range(2014, 2021) r(y), (VALUES ('1'), ('2'), ('3')) k(q)) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.ticker = e.ticker AND c.form_type = e.form_type AND CAST(c.fiscal_year AS INT) = e.fiscal_year AND (e.form_type = '10-K' OR c.fiscal_quarter = e.fiscal_quarter))")),
    "filing_ticker": (filing_ticker, oracle("SELECT cik, CASE cik % 4 WHEN 0 THEN translate(substr(CAST(cik + 1000 AS VARCHAR), 2, 3), '0123456789', 'ABCDEFGHIJ') WHEN 1 THEN translate(substr(CAST(cik + 1000 AS VARCHAR), 2, 3), '0123456789', 'ABCDEFGHIJ') WHEN 2 THEN translate(substr(CAST(cik + 1000 AS VARCHAR), 2, 3), '0123456789', 'KLMNOPQRST') END AS found FROM company")),
    "statement_types": (statement_types, fundamentals._fact_oracle("SELECT tag, CASE WHEN tag = 'UnknownTag' THEN 'unknown' ELSE 'income_statement' END AS statement_type, count(*) AS n FROM fact GROUP BY tag")),
    "call_chunks": (_call_chunks(ch.call_chunks), chunk_sql.CALLS),
    "turn_chunks": (_call_chunks(ch.turn_chunks), chunk_sql.TURNS),
    "remark_chunks": (_call_chunks(ch.remark_chunks), chunk_sql.REMARKS),
    "call_shares": (call_shares, oracle(r"SELECT speaker, count(*) AS n, floor(sum(length(content)) / count(*) * 10000.0 + 0.5) / 10000.0 AS mean_length, floor(sum(len(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> ''))) / count(*) * 10000.0 + 0.5) / 10000.0 AS mean_words, floor(sum(is_analyst) / count(*) * 10000.0 + 0.5) / 10000.0 AS analysts FROM entry GROUP BY speaker")),
    "call_texts": (call_texts, oracle("WITH s AS (SELECT *, CASE WHEN max(is_analyst) OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING) = 1 THEN 'questions' ELSE 'remarks' END AS section FROM entry), n AS (SELECT conv_id, section, speaker, count(*) AS n FROM s GROUP BY ALL) SELECT * FROM (SELECT conv_id, section, md5(string_agg(speaker || ': ' || content, chr(10) ORDER BY seq)) AS text_md5 FROM s GROUP BY ALL) JOIN (SELECT conv_id, section, '{{' || string_agg('\"' || speaker || '\":' || CAST(n AS VARCHAR), ',' ORDER BY speaker) || '}}' AS turns FROM n GROUP BY ALL) USING (conv_id, section)".replace("{{", "{").replace("}}", "}"))),
    "money_formats": (money_formats, MONEY),
    "ratio_keys": (ratio_keys, KEYS),
    "spoken_quarters": (spoken_quarters, SPOKEN),
    "metadata_json": (metadata_json, oracle("SELECT id, ticker, form_type, fiscal_year FROM chunk")),
    "two_sentences": (lambda s, d: view(s, d, "chunk").select("id", F.md5(tx.first_sentences(F.col("content"), 2)).alias("text_md5")), oracle("SELECT id, md5(trim(array_to_string(string_split(content, '.')[1:2], '.'))) AS text_md5 FROM chunk")),
    "query_expansion": (lambda s, d: _queries(s, d).select("conv_id", "seq", "query", se.expanded(F.col("query")).alias("expanded"), se.with_narrative(F.col("query")).alias("narrative")), EXPANSION),
    "query_suggestions": (lambda s, d: se.suggestions(_queries(s, d).select("query").distinct()).select("query", "word", "term", F.array_join("synonyms", ",").alias("synonyms")), SUGGESTIONS),
    "metadata_pairs": (metadata_pairs, oracle("SELECT id, fiscal_year, fiscal_quarter FROM chunk WHERE (fiscal_year = '2016' AND fiscal_quarter = '1') OR (fiscal_year = '2019' AND fiscal_quarter = '2')")),
    "bm25_all": (lambda s, d: se.search("keyword", None, se.bm25(view(s, d, "chunk"), retrieval.QUERY), 20), oracle(f"WITH {_BM25_ALL} SELECT * FROM bm ORDER BY score DESC, id LIMIT 20")),
    "min_words": (lambda s, d: nw.with_words(view(s, d, "chunk"), "content", 50).select("id"), oracle(r"SELECT id FROM chunk WHERE len(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) >= 50")),
    "recommendations": (recommendations, oracle("WITH s AS (SELECT DISTINCT company, regexp_replace(lower(regexp_extract(source_url, '://([^/?#]*)', 1)), '^www\\.', '') AS source FROM news), r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY source) AS k FROM s) SELECT company, string_agg(source, ',' ORDER BY source) AS sources FROM r WHERE k <= 5 GROUP BY company")),
    "recent_titles": (lambda s, d: nw.recent_titles(view(s, d, "news"), "source_url", "2024-03-01"), oracle("SELECT source_url AS title, max(published) AS published FROM news WHERE published BETWEEN DATE '2024-02-23' AND DATE '2024-03-01' AND source_url <> '' GROUP BY source_url ORDER BY published DESC, title LIMIT 5")),
    "topic_report": (lambda s, d: nw.topic_report(view(s, d, "news"), "company", "2024-01-15", "2024-02-20"), oracle("WITH i AS (SELECT *, regexp_replace(lower(regexp_extract(source_url, '://([^/?#]*)', 1)), '^www\\.', '') AS source FROM news WHERE published BETWEEN DATE '2024-01-15' AND DATE '2024-02-20'), g AS (SELECT company, count(*) AS articles, count(DISTINCT published) AS days, count(DISTINCT source) AS sources, min(published) AS first, max(published) AS last, floor(count(*) FILTER (sentiment = 'positive') / count(*) * 1e6 + 0.5) / 1e6 AS up, floor(count(*) FILTER (sentiment = 'negative') / count(*) * 1e6 + 0.5) / 1e6 AS down FROM i GROUP BY company) SELECT company, articles, days, sources, first, last, CASE WHEN up > 0.4 AND up > down THEN 'positive' WHEN down > 0.4 AND down > up THEN 'negative' ELSE 'neutral' END AS sentiment FROM g")),
    "prices_by_ticker": (prices_by_ticker, oracle("SELECT ticker, count(*) AS n, min(date) AS first, max(date) AS last, CAST(sum(volume) AS BIGINT) AS volume, count(*) FILTER (date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20') AS inside FROM price GROUP BY ticker")),
    "adjusted_close": (adjusted_close, oracle("SELECT ticker, date, coalesce(CASE WHEN day(date) % 3 <> 0 THEN close_price * 2 END, close_price) AS adjusted_close FROM price WHERE close_price > 0")),
    "price_null_counts": (lambda s, d: pr.null_counts(view(s, d, "price").select("open_price", "close_price", "volume")), oracle("SELECT count(*) - count(open_price) AS open_price, count(*) - count(close_price) AS close_price, count(*) - count(volume) AS volume FROM price")),
}
