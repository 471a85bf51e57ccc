"""Queries of search, chunks, transcripts, news and usage, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fiscal, text as tx
from ..functions.numbers import rounded
from ..operators import chunks as ch, news as nw, search as se, transcripts as tr, usage as us
from . import chunk_sql
from .views import oracle, view

QUERY = "is the of that idiot"


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "chunk")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of row 0: one row."""
    return [float(x) for x in _vectors(spark, sf_dir).filter("id = 0").first()["vector"]]


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top(se.bm25(_chunks(spark, sf_dir).filter("section_name = 'en'"), QUERY), 20)


_W = QUERY.split()
_TOKENS = r"list_filter(regexp_split_to_array(lower(content), '\s+'), lambda t: t <> '')"
_BM25 = f"""
toks AS (SELECT id, {_TOKENS} AS w FROM chunk WHERE section_name = 'en'), docs AS (SELECT id, w, len(w) AS dl FROM toks WHERE len(w) > 0),
tot AS (SELECT count(*) AS n, avg(dl) AS mean FROM docs), df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, unnest(w) AS word FROM docs) GROUP BY word),
idf AS (SELECT word, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, tot), mi AS (SELECT avg(idf) AS m FROM idf),
wt AS (SELECT word, CASE WHEN idf < 0 THEN m * 0.25 ELSE idf END AS wt FROM idf, mi), tf AS (SELECT id, dl, word, count(*) AS tf FROM (SELECT id, dl, unnest(w) AS word FROM docs) GROUP BY ALL),
scores AS (SELECT id, floor(sum(wt * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) * 1e6 + 0.5) / 1e6 AS score FROM tf JOIN wt USING (word) CROSS JOIN tot WHERE word IN ({", ".join(f"'{w}'" for w in _W)}) GROUP BY id),
bm AS (SELECT * FROM scores WHERE score > 0)"""
_DIST = "list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings WHERE vec_id = 0)), lambda p: (CAST(p[1] AS DOUBLE) - p[2]) * (CAST(p[1] AS DOUBLE) - p[2])))"
_SEM = f"dist AS (SELECT vec_id AS id, label, {_DIST} AS d FROM embeddings), sem AS (SELECT id, floor((0 - d) * 1e6 + 0.5) / 1e6 AS score FROM dist), inv AS (SELECT id, floor(1 / (1 + d) * 1e6 + 0.5) / 1e6 AS score FROM dist)"
_TOP = "(SELECT * FROM {0} ORDER BY score DESC, id LIMIT {1})"


def _scaled(name: str, k: int) -> str:
    return f"(SELECT id, (score - min(score) OVER ()) / CASE WHEN max(score) OVER () > min(score) OVER () THEN max(score) OVER () - min(score) OVER () ELSE 1 END AS score FROM {_TOP.format(name, k)})"


def _arms(spark: SparkSession, sf_dir: str, form: str = "negative") -> tuple[DataFrame, DataFrame]:
    return se.by_vector(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), form), se.bm25(_chunks(spark, sf_dir).filter("section_name = 'en'"), QUERY)


def vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.top(se.by_vector(_vectors(spark, sf_dir).filter("label = 3"), _query_vector(spark, sf_dir), "inverse"), 10)


def balanced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).withColumn("score", tx.keyword_score(F.col("content"), "is the")).filter("score > 0")
    return se.balanced(rows, "fiscal_year", 11, ["2015", "2018", "2020"]).select("id", "fiscal_year", "score", "place")


_SCORE = " + ".join(f"CAST((length(low) - length(replace(low, '{w}', ''))) // {len(w)} AS INT)" for w in ("is", "the"))
_SCORED = f"scored AS (SELECT *, {_SCORE} + CASE WHEN contains(low, 'is the') THEN 3 ELSE 0 END AS score FROM (SELECT *, lower(content) AS low FROM chunk))"


def relaxed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No chunk of this quarter has this section: the last filter is dropped."""
    return se.relaxed(_chunks(spark, sf_dir), [F.col("fiscal_year") == "2016", F.col("section_name") == "de", F.col("fiscal_quarter") == "9"]).select("id", "tier")


def vector_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir)
    return rows.filter(se.where({"section_name": ["en", "de ", "en"], "fiscal_quarter": "Q2", "form_type": "10-Q", "not_there": "x"}, rows.columns)).select("id", "fiscal_year")


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, density, tags and section of each chunk; some words of the trade are put in by key."""
    c = F.concat(F.col("content"), F.when(F.col("id") % 7 == 0, " cash flow and risk factors").when(F.col("id") % 11 == 0, " Sales of our products").otherwise(""))
    rows = _chunks(spark, sf_dir).withColumn("text", c).withColumn("section_name", F.when(F.col("id") % 2 == 0, "Other").otherwise(F.col("section_name")))
    return ch.enriched(rows).select("id", "text_hash", "numeric_density", F.array_join("tags", ",").alias("tags"), "section")


_TAG_CASES = ", ".join(f"CASE WHEN contains(low, '{w}') THEN '{t}' END" for w, t in tx.TAG_WORDS.items())
ENRICHMENT = oracle(f"""WITH t AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'Other' ELSE section_name END AS given, content || CASE WHEN id % 7 = 0 THEN ' cash flow and risk factors' WHEN id % 11 = 0 THEN ' Sales of our products' ELSE '' END AS text FROM chunk), l AS (SELECT *, lower(text) AS low FROM t)
SELECT id, md5(text) AS text_hash, floor(length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) * 10000.0 + 0.5) / 10000.0 AS numeric_density, array_to_string(list_sort(list_distinct(list_filter([{_TAG_CASES}], lambda x: x IS NOT NULL))), ',') AS tags,
  CASE WHEN lower(given) NOT IN ('unclassified content', '', 'other', 'unknown') THEN given WHEN regexp_matches(low, 'management''?s\\s+discussion|results of operations|liquidity|capital resources') THEN 'Management''s Discussion and Analysis' WHEN regexp_matches(low, 'risk factors') THEN 'Risk Factors' WHEN regexp_matches(low, '\\b(the )?company\\b|products?\\b|services?\\b|market\\b') THEN 'Business' ELSE given END AS section FROM l""")


def chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.one_of_each_start(_chunks(spark, sf_dir), ["ticker"], "id", "content", 2000).select("id", "ticker")


DEDUP = oracle(r"SELECT id, ticker FROM (SELECT id, ticker, content, row_number() OVER (PARTITION BY ticker, lower(trim(regexp_replace(substr(content, 1, 100), '\s+', ' ', 'g'))) ORDER BY id) AS rn FROM chunk) WHERE rn = 1 AND length(content) BETWEEN 20 AND 2400")


def hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chunks(spark, sf_dir).select("id", "ticker", F.md5("content").alias("text_hash"))
    return ch.one_of_each_hash(rows, "id")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "entry")


def transcript_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tr.features(_entries(spark, sf_dir))
    return out.select("conv_id", "content_length", "word_count", F.array_join("participants", ",").alias("participants"), "revenue_mentioned", "guidance_mentioned", F.size("terms").alias("terms"))


_U = "OVER (PARTITION BY conv_id ORDER BY seq ROWS UNBOUNDED PRECEDING)"
_STARTS = " OR ".join(f"starts_with(low, '{s} ')" for s in tx.QUESTION_STARTS)
_ASKED = "(" + " OR ".join("regexp_matches(low, '" + p.replace("'", "''") + "')" for p in tx.QUESTION_PATTERNS) + f" OR contains(content, '?') OR {_STARTS})"
_LOW = "l AS (SELECT *, lower(trim(content)) AS low FROM entry)"
_ANY = lambda patterns: "(" + " OR ".join("regexp_matches(lower(content), '" + p + "')" for p in patterns) + ")"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.labelled(_entries(spark, sf_dir)).groupBy("conv_id", "label").agg(F.count(F.lit(1)).alias("n"))


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ch.html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html").select(F.col("id").alias("page_id"), F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _cut(make):
    return lambda spark, sf_dir: make(_chunks(spark, sf_dir), "id", "content").select("id", "seq", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def adaptive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines taken for paragraphs: the texts have no empty lines, so only here short ones are put together."""
    lines = _chunks(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\n\n")))
    return ch.paragraph_chunks(lines, "id", "content").select("id", "seq", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "news")


PRICES = {"m0": (3.0, 15.0), "m1": (0.25, 1.25)}


def trend_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return us.trend(view(spark, sf_dir, "income").filter("period_length_months = 3"), ["cik"], "period_end_date", "total_revenue")


TREND = oracle("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY period_end_date DESC) AS k FROM income WHERE period_length_months = 3 AND total_revenue IS NOT NULL), g AS (SELECT cik, min_by(total_revenue, period_end_date) AS first, max_by(total_revenue, period_end_date) AS last, count(*) AS n FROM r WHERE k <= 4 GROUP BY cik)
SELECT cik, first, last, n, CASE WHEN n < 2 THEN 'insufficient_data' WHEN CAST(last AS DOUBLE) > CAST(first AS DOUBLE) * CAST(1.05 AS DOUBLE) THEN 'improving' WHEN CAST(last AS DOUBLE) < CAST(first AS DOUBLE) * CAST(0.95 AS DOUBLE) THEN 'declining' ELSE 'stable' END AS trend FROM g""")


def latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").filter("period_length_months in (3, 12)").select("cik", "fiscal_year", F.when(F.col("period_type") != "FY", F.substring("period_type", 2, 1).cast("int")).alias("fiscal_quarter"), "period_end_date", F.when(F.col("period_type") == "FY", "10-K").otherwise("10-Q").alias("form_type"), F.col("gross_profit").isNotNull().alias("known")).filter("known or form_type = '10-Q'").drop("known")
    return fiscal.latest_year_and_quarter(rows, ["cik"])


LATEST = oracle("""WITH r AS (SELECT * FROM (SELECT cik, fiscal_year, CAST(CASE WHEN period_type <> 'FY' THEN substr(period_type, 2, 1) END AS INT) AS q, period_end_date AS d, CASE WHEN period_type = 'FY' THEN '10-K' ELSE '10-Q' END AS f, gross_profit IS NOT NULL AS known FROM income WHERE period_length_months IN (3, 12)) WHERE known OR f = '10-Q'),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fiscal_year DESC, d DESC) AS rn FROM r WHERE f = '10-K') WHERE rn = 1), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY fiscal_year DESC, q DESC, d DESC) AS rn FROM r WHERE f = '10-Q') WHERE rn = 1)
SELECT cik, k.fiscal_year AS latest_year, k.d AS year_end, p.fiscal_year AS quarter_year, p.q AS latest_quarter, p.d AS quarter_end, CASE WHEN k.cik IS NULL OR p.d > k.d THEN '10-Q' ELSE '10-K' END AS newest FROM k FULL JOIN p USING (cik)""")


def fiscal_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "income").select("cik", "period_end_date").distinct()
    month = (F.col("cik") % 12 + 1).cast("int")
    mmdd = F.concat(F.lpad(month.cast("string"), 2, "0"), F.lit("28"))
    return rows.select("cik", "period_end_date", fiscal.year_of(F.col("period_end_date"), mmdd).alias("year"), fiscal.quarter_of(F.col("period_end_date"), month).alias("quarter"))


FISCAL = oracle("SELECT cik, d AS period_end_date, CAST(year(d) + CASE WHEN strftime(d, '%m%d') > lpad(CAST(cik % 12 + 1 AS VARCHAR), 2, '0') || '28' THEN 1 ELSE 0 END AS INT) AS year, CAST((month(d) - (cik % 12 + 1) - 1 + 24) % 12 // 3 + 1 AS INT) AS quarter FROM (SELECT DISTINCT cik, period_end_date AS d FROM income)")


def quarters_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = view(spark, sf_dir, "company").select("cik", F.to_date(F.lit("1998-05-01")).alias("a"), F.to_date(F.lit("2002-02-01")).alias("b"))
    expected = fiscal.quarters_between(span, "a", "b", 1996).select("cik", "year", "quarter")
    held = view(spark, sf_dir, "balance").filter("total_assets is not null").select("cik", F.col("fiscal_year").alias("year"), F.substring("fiscal_quarter", 2, 1).cast("int").alias("quarter"))
    return tr.missing_quarters(expected, held, ["cik", "year", "quarter"])


FETCH = oracle("SELECT cik, CAST(q // 4 AS INT) AS year, CAST(q % 4 + 1 AS INT) AS quarter FROM company, range(1998 * 4 + 1, 2002 * 4 + 1) t(q) WHERE NOT EXISTS (SELECT 1 FROM balance b WHERE b.cik = company.cik AND b.total_assets IS NOT NULL AND b.fiscal_year = q // 4 AND CAST(substr(b.fiscal_quarter, 2, 1) AS INT) = q % 4 + 1)")


def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "usage").groupBy("run_id").agg(F.count_if(F.col("agent_type") == "analyst").alias("m"), F.count_if(F.col("agent_type") == "reviewer").alias("p"), F.count_if(F.col("agent_type") == "master").alias("c"), F.count_if(F.col("input_tokens") < 40).alias("e"))
    return rows.select("run_id", us.quality(F.col("m"), F.col("p"), F.col("c"), F.col("e")).alias("score"))


QUERIES = {
    "bm25_topk": (bm25_topk, oracle(f"WITH {_BM25} SELECT * FROM bm ORDER BY score DESC, id LIMIT 20")),
    "vector_topk": (lambda s, d: se.top(_arms(s, d)[0], 10), f"WITH {_SEM} SELECT * FROM sem ORDER BY score DESC, id LIMIT 10"),
    "vector_topk_filtered": (vector_filtered, f"WITH {_SEM} SELECT i.* FROM inv i JOIN dist USING (id) WHERE label = 3 ORDER BY score DESC, id LIMIT 10"),
    "hybrid_minmax": (lambda s, d: se.hybrid(*_arms(s, d), 10), oracle(f"WITH {_BM25}, {_SEM} SELECT id, floor((coalesce(a.score, 0) * 0.7 + coalesce(b.score, 0) * 0.3) * 1e6 + 0.5) / 1e6 AS score FROM {_scaled('sem', 20)} a FULL JOIN {_scaled('bm', 20)} b USING (id) ORDER BY score DESC, id LIMIT 10")),
    "hybrid_penalty": (
        lambda s, d: se.hybrid_penalised(*_arms(s, d, "inverse"), _chunks(s, d), 10),
        oracle(f"WITH {_BM25}, {_SEM}, m AS (SELECT id, coalesce(a.score, 0) * 0.4 + coalesce(b.score, 0) * 0.6 AS v FROM {_scaled('inv', 20)} a FULL JOIN {_scaled('bm', 20)} b USING (id)), x AS (SELECT id, v, content, lower(trim(content)) AS low FROM m JOIN chunk USING (id)) SELECT id, floor(CASE WHEN length(trim(content)) < 50 OR " + " OR ".join("regexp_matches(low, '" + p.replace("'", "''") + "')" for p in tx.POOR_PATTERNS) + " THEN v * 0.1 ELSE v END * 1e6 + 0.5) / 1e6 AS score FROM x ORDER BY score DESC, id LIMIT 10"),
    ),
    "hybrid_rrf": (lambda s, d: se.hybrid_ranked(*_arms(s, d), 10), oracle(f"WITH {_BM25}, {_SEM}, a AS (SELECT id, 1.0 / row_number() OVER (ORDER BY score DESC, id) AS score FROM {_TOP.format('sem', 20)}) SELECT id, floor((coalesce(a.score, 0) * 0.6 + coalesce(b.score, 0) * 0.4) * 1e6 + 0.5) / 1e6 AS score FROM a FULL JOIN {_TOP.format('bm', 20)} b USING (id) ORDER BY score DESC, id LIMIT 10")),
    "keyword_score": (lambda s, d: se.top(_chunks(s, d).select("id", tx.keyword_score(F.col("content"), "is the").alias("score")).filter("score > 0"), 20), oracle(f"WITH {_SCORED} SELECT id, score FROM scored WHERE score > 0 ORDER BY score DESC, id LIMIT 20")),
    "balanced_topk": (balanced_topk, oracle(f"WITH {_SCORED} SELECT id, fiscal_year, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fiscal_year ORDER BY score DESC, id) AS INT) AS place FROM scored WHERE score > 0 AND fiscal_year IN ('2015', '2018', '2020')) WHERE place <= CASE fiscal_year WHEN '2020' THEN 3 ELSE 4 END")),
    "relaxed_search": (relaxed_search, oracle("WITH t AS (SELECT id, CASE WHEN fiscal_year = '2016' AND section_name = 'de' AND fiscal_quarter = '9' THEN 0 WHEN fiscal_year = '2016' AND section_name = 'de' THEN 1 WHEN fiscal_year = '2016' THEN 2 ELSE 3 END AS tier FROM chunk) SELECT id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)")),
    "metadata_where": (vector_where, oracle("SELECT id, fiscal_year FROM chunk WHERE section_name IN ('en', 'de') AND fiscal_quarter = '2' AND form_type = '10-Q'")),
    "last_reports": (lambda s, d: se.last_reports(_chunks(s, d), 3, ["ticker"]).select("id", "ticker", "report"), oracle("WITH r AS (SELECT id, ticker, CAST(fiscal_year AS INT) * 10 + CASE WHEN form_type = '10-K' THEN 5 ELSE TRY_CAST(fiscal_quarter AS INT) END AS report FROM chunk) SELECT id, ticker, report FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY report DESC) AS k FROM r) WHERE k <= 3")),
    "filter_summary": (lambda s, d: se.filter_summary(_chunks(s, d), ["form_type", "fiscal_year"]).select("n", "mean_length", F.array_join("form_type", ",").alias("form_type"), F.array_join("fiscal_year", ",").alias("fiscal_year")), oracle("SELECT count(*) AS n, floor(avg(length(content)) * 10000.0 + 0.5) / 10000.0 AS mean_length, array_to_string(list_sort(list(DISTINCT form_type)), ',') AS form_type, array_to_string(list_sort(list(DISTINCT fiscal_year)), ',') AS fiscal_year FROM chunk")),
    "filter_report": (lambda s, d: se.filter_report(_chunks(s, d), {"form_type": "10-K", "section_name": "en"}), oracle("SELECT count(*) AS n, count(*) FILTER (form_type = '10-K') AS form_type, count(*) FILTER (section_name = 'en') AS section_name FROM chunk")),
    "chunk_enrichment": (enrichment, ENRICHMENT),
    "chunk_dedup": (chunk_dedup, DEDUP),
    "text_hash": (hash_dedup, oracle("SELECT text_hash, id, ticker FROM (SELECT id, ticker, md5(content) AS text_hash, row_number() OVER (PARTITION BY md5(content) ORDER BY id) AS rn FROM chunk) WHERE rn = 1")),
    "sentence_chunks": (_cut(ch.sentence_chunks), chunk_sql.SENTENCES),
    "adaptive_chunks": (_cut(ch.paragraph_chunks), chunk_sql.PARAGRAPHS),
    "adaptive_lines": (adaptive_lines, chunk_sql.LINES),
    "micro_chunks": (_cut(ch.micro_chunks), chunk_sql.MICRO),
    "html_text": (html_text, chunk_sql.PAGES),
    "section_split": (lambda s, d: tr.split_at_first_analyst(_entries(s, d)).select("conv_id", "seq", "section"), oracle(f"SELECT conv_id, seq, CASE WHEN max(is_analyst) {_U} = 1 THEN 'questions' ELSE 'remarks' END AS section FROM entry")),
    "qa_groups": (lambda s, d: tr.question_chunks(_entries(s, d)).select("conv_id", "group", "primary", "entries", F.md5("text").alias("text_md5")), oracle(f'WITH g AS (SELECT *, CAST(sum(is_analyst) {_U} AS INT) AS g FROM entry) SELECT conv_id, g AS "group", min_by(speaker, seq) FILTER (is_analyst = 0) AS "primary", CAST(count(*) AS INT) AS entries, md5(string_agg(speaker || \': \' || content, chr(10) || chr(10) ORDER BY seq)) AS text_md5 FROM g WHERE g > 0 GROUP BY conv_id, g')),
    "qa_pairs": (lambda s, d: tr.pairs(_entries(s, d)).select("conv_id", "seq", "pair"), oracle(f"WITH {_LOW}, p AS (SELECT conv_id, seq, CAST(sum(CASE WHEN {_ASKED} THEN 1 ELSE 0 END) {_U} AS INT) AS pair FROM l) SELECT * FROM p WHERE pair > 0")),
    "section_labels": (labelled, oracle(f"WITH {_LOW}, c AS (SELECT *, CASE WHEN {_ANY([p for p in tx.QA_PATTERNS])} OR contains(lower(speaker), 'operator') OR {_ASKED} THEN 'qa_session' WHEN {_ANY(tx.CLOSING_PATTERNS)} THEN 'closing_remarks' END AS change FROM l), f AS (SELECT conv_id, coalesce(last_value(change IGNORE NULLS) {_U}, 'opening_remarks') AS label FROM c) SELECT conv_id, label, count(*) AS n FROM f GROUP BY ALL")),
    "transcript_features": (transcript_features, oracle(r"WITH t AS (SELECT conv_id, string_agg(content, chr(10) ORDER BY seq) AS text, list_distinct(list(speaker ORDER BY seq)) AS u, list(speaker ORDER BY seq) AS s FROM entry GROUP BY conv_id) SELECT conv_id, CAST(length(text) AS INT) AS content_length, CAST(len(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS INT) AS word_count, array_to_string(list_filter(s, lambda x, i: list_position(s, x) = i), ',') AS participants, regexp_matches(lower(text), '\b(?:revenue|sales|income)\b') AS revenue_mentioned, regexp_matches(lower(text), '\b(?:guidance|outlook|forecast|expect)\b') AS guidance_mentioned, CAST(len(list_distinct(regexp_extract_all(lower(text), '" + tx.any_of(tx.TERMS) + "'))) AS INT) AS terms FROM t")),
    "speaker_chunks": (lambda s, d: tr.speaker_chunks(_entries(s, d), words=50).select("conv_id", "seq", "piece", F.size(F.split("text", " ")).alias("words")), oracle(r"WITH w AS (SELECT conv_id, seq, len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS n FROM entry) SELECT conv_id, seq, CAST(k AS INT) AS piece, CAST(least(50, n - k * 50) AS INT) AS words FROM w, range(0, 1000) t(k) WHERE k * 50 < n")),
    "news_url_dedup": (lambda s, d: nw.one_of_each_url(_news(s, d).withColumn("source_url", F.regexp_replace("source_url", "[?#].*$", ""))).select("source_url", "chunk_id", "company"), oracle("SELECT source_url, chunk_id, company FROM (SELECT regexp_replace(source_url, '[?#].*$', '') AS source_url, chunk_id, company, row_number() OVER (PARTITION BY regexp_replace(source_url, '[?#].*$', '') ORDER BY chunk_id) AS rn FROM news) WHERE rn = 1")),
    "sentiment_majority": (lambda s, d: nw.sentiment(_news(s, d), ["company"]), oracle("WITH g AS (SELECT company, count(*) AS articles, floor(count(*) FILTER (sentiment = 'positive') / count(*) * 1e6 + 0.5) / 1e6 AS positive, floor(count(*) FILTER (sentiment = 'negative') / count(*) * 1e6 + 0.5) / 1e6 AS negative FROM news GROUP BY company) SELECT *, CASE WHEN positive > 0.4 AND positive > negative THEN 'positive' WHEN negative > 0.4 AND negative > positive THEN 'negative' ELSE 'neutral' END AS sentiment, CASE WHEN articles >= 5 THEN 'high' WHEN articles >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM g")),
    "news_histogram": (lambda s, d: nw.by_date(nw.within(_news(s, d), "2024-01-15", "2024-02-20")), oracle("SELECT published, count(*) AS n FROM news WHERE published BETWEEN DATE '2024-01-15' AND DATE '2024-02-20' GROUP BY published")),
    "source_domain": (lambda s, d: nw.by_domain(_news(s, d)), oracle("SELECT regexp_replace(lower(regexp_extract(source_url, '://([^/?#]*)', 1)), '^www\\.', '') AS domain, count(*) AS n FROM news GROUP BY 1")),
    "news_summary": (lambda s, d: nw.summary(_news(s, d)), oracle("SELECT count(*) AS n, count(DISTINCT company) AS companies, min(published) AS first, max(published) AS last FROM news")),
    "cost_rollup": (lambda s, d: us.rollup(view(s, d, "usage"), PRICES, "run_id", "agent_type"), oracle("WITH g AS (SELECT run_id, agent_type, model_id, sum(input_tokens) AS i, sum(output_tokens) AS o, count(*) AS c FROM usage GROUP BY ALL), p AS (SELECT *, CAST(round((i / 1000000 * CASE model_id WHEN 'm0' THEN 3.0 WHEN 'm1' THEN 0.25 ELSE 0 END + o / 1000000 * CASE model_id WHEN 'm0' THEN 15.0 WHEN 'm1' THEN 1.25 ELSE 0 END) * 1000000) AS BIGINT) AS m FROM g) SELECT run_id, agent_type, CAST(sum(c) AS BIGINT) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, CAST(sum(m) AS BIGINT) / 1000000 AS cost FROM p GROUP BY ALL")),
    "trend_last_n": (trend_last_n, TREND),
    "quality_score": (quality_score, oracle("WITH g AS (SELECT run_id, count(*) FILTER (agent_type = 'analyst') AS m, count(*) FILTER (agent_type = 'reviewer') AS p, count(*) FILTER (agent_type = 'master') AS c, count(*) FILTER (input_tokens < 40) AS e FROM usage GROUP BY run_id) SELECT run_id, floor(greatest(0e0, least(m / 10e0, 1e0) * 0.4e0 + least(p / 8e0, 1e0) * 0.4e0 + CASE WHEN c > 0 THEN 0.2e0 ELSE 0e0 END - least(e * 0.1e0, 0.3e0)) * 100e0 + 0.5e0) / 100e0 AS score FROM g")),
    "latest_reports": (latest_reports, LATEST),
    "fiscal_dates": (fiscal_dates, FISCAL),
    "quarters_to_fetch": (quarters_to_fetch, FETCH),
}
