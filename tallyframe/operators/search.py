"""Retrieval: BM25, vectors, hybrids, balanced and relaxed searches over rows of chunks (id, content, ...)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded
from ..functions.synonyms import NARRATIVE, NARRATIVE_CUES, PHRASES, SYNONYMS

K1, B, EPSILON = 1.5, 0.75, 0.25


def _quarter(value: object) -> str:
    return re.sub(r"(?i)^q(?=\d)", "", str(value).strip())


def periods_of(labels: list[str]) -> dict:
    """Filters for labels like Q1 2024, 2 2023 or Q3: pairs where each has a year, else the quarters."""
    parts = [str(x).split() for x in labels]
    if parts and all(len(p) == 2 for p in parts):
        return {"periods": list(dict.fromkeys((p[1], _quarter(p[0])) for p in parts))}
    return {"fiscal_quarter": list(dict.fromkeys(_quarter(p[0]) for p in parts if p))}


def where(filters: dict, columns: list[str]) -> Column:
    """A predicate of {column: value or list, date_from/date_to: of filing_date, periods: [(year, quarter), ...]}; values are trimmed, a quarter may begin with Q.

    Where periods are given they stand for fiscal_year and fiscal_quarter: the pairs that were asked for, not all years with all quarters. Columns that aren't there are left out."""
    out = F.lit(True)
    pairs = [(str(y).strip(), _quarter(q)) for y, q in filters.get("periods") or ()]
    if pairs and {"fiscal_year", "fiscal_quarter"} <= set(columns):
        year, quarter = F.col("fiscal_year").cast("string"), F.regexp_replace(F.col("fiscal_quarter").cast("string"), r"(?i)^q(?=\d)", "")
        out &= reduce(lambda a, b: a | b, ((year == y) & (quarter == q) for y, q in pairs))
        filters = {k: v for k, v in filters.items() if k not in ("fiscal_year", "fiscal_quarter")}
    for name, value in filters.items():
        if name in ("date_from", "date_to"):
            if "filing_date" in columns:
                out &= F.col("filing_date") >= value if name == "date_from" else F.col("filing_date") <= value
            continue
        if name not in columns or value in (None, "", []):
            continue
        values = list(dict.fromkeys(v.strip() if isinstance(v, str) else v for v in (value if isinstance(value, list | tuple | set) else [value])))
        if name == "fiscal_quarter":
            values = list(map(_quarter, values))
        out &= F.col(name).isin(values) if len(values) > 1 else F.col(name) == F.lit(values[0])
    return out


def bm25(chunks: DataFrame, query: str) -> DataFrame:
    """id and score (> 0) of the rows given: statistics are those of these rows, so filter them before. A word that the query repeats counts as often.

    Words that most rows hold have a negative weight; it becomes EPSILON times the mean weight of all words."""
    words = query.lower().split()
    wanted = list(dict.fromkeys(words))
    rows = chunks.select("id", tx.tokens(F.col("content")).alias("words")).filter("size(words) > 0")
    rows = rows.select("id", F.size("words").alias("length"), "words", *(_count(q).alias(f"tf{k}") for k, q in enumerate(wanted)))
    totals = rows.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(wanted))))
    df = rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weight = lambda n, d: F.log(n - d + 0.5) - F.log(d + 0.5)
    # the number of rows is one value, so this joins one row to the words
    mean = df.groupBy("df").agg(F.count(F.lit(1)).alias("words")).crossJoin(F.broadcast(totals.select("docs"))).agg((F.sum(F.col("words") * weight(F.col("docs"), F.col("df"))) / F.sum("words")).alias("mean_weight"))
    scored = rows.drop("words").filter(reduce(lambda a, b: a | b, (F.col(f"tf{k}") > 0 for k in range(len(wanted))))).crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(mean))
    score = F.lit(0.0)
    for q in words:
        k = wanted.index(q)
        w = weight(F.col("docs"), F.col(f"df{k}"))
        w = F.when(w < 0, F.col("mean_weight") * EPSILON).otherwise(w)
        tf = F.col(f"tf{k}")
        score = score + F.when(tf > 0, w * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(0.0)
    return scored.select("id", rounded(score).alias("score")).filter("score > 0")


def _count(word: str) -> Column:
    return F.size(F.filter("words", lambda w: w == word))


def squared_distance(vector: Column, query: list[float]) -> Column:
    pairs = F.zip_with(vector, F.array(*(F.lit(float(x)) for x in query)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.aggregate(pairs, F.lit(0.0), lambda a, b: a + b)


def by_vector(rows: DataFrame, query: list[float], form: str = "negative") -> DataFrame:
    """id and score by distance: negative (-d) or inverse (1 / (1 + d)). Exact: the query is a constant, the rows are scanned once."""
    d = squared_distance(F.col("vector"), query)
    return rows.filter("vector is not null").select("id", rounded(-d if form == "negative" else 1.0 / (1.0 + d)).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best; a tie goes by id. One sort of k rows a partition."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def _scaled(c: str) -> Column:
    """Over the whole result: least 0, greatest 1; a result of one value is 0."""
    w = Window.partitionBy()
    low, high = F.min(c).over(w), F.max(c).over(w)
    return (F.col(c) - low) / F.when(high > low, high - low).otherwise(1.0)


def merged(semantic: DataFrame, keyword: DataFrame) -> DataFrame:
    return semantic.select("id", F.col("score").alias("s")).join(keyword.select("id", F.col("score").alias("k")), "id", "full")


def hybrid(semantic: DataFrame, keyword: DataFrame, k: int, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """The 2k best of each, scaled to 0..1, weighted, and the k best of that. The results are 4k rows at most, so scaling them takes one task."""
    s, w = top(semantic, 2 * k).withColumn("score", _scaled("score")), top(keyword, 2 * k).withColumn("score", _scaled("score"))
    out = merged(s, w).select("id", rounded(F.coalesce("s", F.lit(0.0)) * weights[0] + F.coalesce("k", F.lit(0.0)) * weights[1]).alias("score"))
    return top(out, k)


def hybrid_penalised(semantic: DataFrame, keyword: DataFrame, chunks: DataFrame, k: int, weights: tuple[float, float] = (0.4, 0.6), penalty: float = 0.1) -> DataFrame:
    """As hybrid(), and poor passages lose nine tenths of their score."""
    s, w = top(semantic, 2 * k).withColumn("score", _scaled("score")), top(keyword, 2 * k).withColumn("score", _scaled("score"))
    out = merged(s, w).join(chunks.select("id", "content"), "id").withColumn("v", F.coalesce("s", F.lit(0.0)) * weights[0] + F.coalesce("k", F.lit(0.0)) * weights[1])
    return top(out.select("id", rounded(F.when(tx.poor(F.col("content")), F.col("v") * penalty).otherwise(F.col("v"))).alias("score")), k)


def hybrid_ranked(semantic: DataFrame, keyword: DataFrame, k: int, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Reciprocal rank of the one, raw score of the other."""
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    out = merged(top(semantic, 2 * k).withColumn("score", 1.0 / rank), top(keyword, 2 * k))
    return top(out.select("id", rounded(F.coalesce("s", F.lit(0.0)) * weights[0] + F.coalesce("k", F.lit(0.0)) * weights[1]).alias("score")), k)


def balanced(scores: DataFrame, group: str, k: int, groups: list) -> DataFrame:
    """k rows over groups: k // n of each, and one more of the first groups until k are given."""
    quota = {g: k // len(groups) + (i < k % len(groups)) for i, g in enumerate(groups)}
    w = Window.partitionBy(group).orderBy(F.desc("score"), "id")
    allowed = F.element_at(F.create_map(*(F.lit(x) for kv in quota.items() for x in kv)), F.col(group))
    return scores.filter(F.col(group).isin(groups)).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= allowed)


def relaxed(rows: DataFrame, filters: list[Column]) -> DataFrame:
    """Rows of the strictest set of filters that any row meets: all, then all but the last, and so on; tier says how many were dropped."""
    tier = F.lit(None).cast("int")
    for dropped in range(len(filters), -1, -1):
        met = reduce(lambda a, b: a & b, filters[: len(filters) - dropped], F.lit(True))
        tier = F.when(met, dropped).otherwise(tier)
    tiered = rows.withColumn("tier", tier)
    return tiered.join(F.broadcast(tiered.agg(F.min("tier").alias("tier"))), "tier", "left_semi")


def last_reports(rows: DataFrame, n: int, key: list[str]) -> DataFrame:
    """Rows of the n latest reports of each key: fiscal year, and in it the yearly report after the quarters. Reports are ranked, not their rows: however many rows a report has, a task gets one of it."""
    order = F.col("fiscal_year").cast("int") * 10 + F.when(F.col("form_type") == "10-K", 5).otherwise(F.expr("try_cast(fiscal_quarter as int)"))
    own = rows.withColumn("report", order)
    latest = own.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("report").alias("_report")).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*(f"_{k}" for k in key)).orderBy(F.desc("_report")))).filter(F.col("_r") <= n)
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*key, "report"]))
    return own.join(latest, on, "left_semi")


def filter_summary(rows: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """Number of rows, mean length, and the different values of each column in order: all, or the first `most`.

    Values are made distinct before any task gathers them, so what is gathered is the answer itself."""
    pairs = rows.select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns)))).filter("v is not null").distinct()
    if most is not None:
        pairs = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("c").orderBy("v"))).filter(F.col("_r") <= most)
    values = pairs.agg(*(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.col("v")))).alias(c) for c in columns))
    return rows.agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.length("content")), 4).alias("mean_length")).crossJoin(F.broadcast(values))  # a row each


def filter_report(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """How many of the rows meet each filter."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(c) == v).alias(c) for c, v in filters.items()))


# queries in words ---------------------------------------------------------------------------------------------------
def _names(head: str) -> list[str]:
    """All that a term is called, in lower case and as single words: phrases are sought by PHRASES."""
    return sorted({n.lower() for n in (head, *SYNONYMS[head]) if re.fullmatch(r"\w+", n)})


def expansion(query: Column, synonyms: int = 2, most: int | None = 6) -> Column:
    """Synonyms of a query's words and phrases, by alphabet: so many of each term, and so many in all (None: all). The table is a constant of the plan."""
    low = F.lower(query)
    words = F.regexp_extract_all(low, F.lit(r"\b(\w+)\b"), F.lit(1))
    found = []
    for head, others in SYNONYMS.items():
        met = F.arrays_overlap(words, F.array(*map(F.lit, _names(head) or [head.lower()])))
        for pattern in (p for p, h in PHRASES.items() if h == head):
            met |= low.rlike(pattern)
        found.append(F.when(met, F.array(*map(F.lit, others[:synonyms]))).otherwise(F.array().cast("array<string>")))
    extra = F.array_sort(F.array_distinct(F.array_except(F.flatten(F.array(*found)), words)))
    return extra if most is None else F.slice(extra, 1, most)


def expanded(query: Column, synonyms: int = 2, most: int | None = 6) -> Column:
    """The query with its expansion."""
    extra = expansion(query, synonyms, most)
    return F.when(F.size(extra) > 0, F.concat(query, F.lit(" "), F.array_join(extra, " "))).otherwise(query)


def suggestions(queries: DataFrame, query: str = "query", synonyms: int = 5) -> DataFrame:
    """query, word, term and the first synonyms of each term that a word of a query stands for. The table is a constant of the plan."""
    words = queries.select(query, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"\b(\w+)\b"), F.lit(1)))).alias("word"))
    by_word: dict[str, list[str]] = {}
    for head in SYNONYMS:
        for name in _names(head):
            by_word.setdefault(name, []).append(head)
    terms = F.create_map(*(x for w, heads in by_word.items() for x in (F.lit(w), F.array(*map(F.lit, heads)))))
    met = words.filter(F.col("word").isin(*by_word)).select(query, "word", F.explode(F.element_at(terms, F.col("word"))).alias("term"))
    others = F.create_map(*(x for h, o in SYNONYMS.items() for x in (F.lit(h), F.array(*map(F.lit, o[:synonyms])))))
    return met.withColumn("synonyms", F.element_at(others, F.col("term")))


def with_narrative(query: Column) -> Column:
    """A query on revenue, growth and the like, with words that bring up the narrative rather than tables."""
    return F.when(F.lower(query).rlike("|".join(NARRATIVE_CUES)), F.concat(query, F.lit(" " + NARRATIVE))).otherwise(query)


def search(method: str, semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """The k best by a method: semantic, keyword (or bm25), else hybrid."""
    if method == "semantic":
        return top(semantic, k)
    return top(keyword, k) if method in ("keyword", "bm25") else hybrid(semantic, keyword, k)
