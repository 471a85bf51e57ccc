"""News: rows (chunk_id, source_url, published, sentiment, company, ...) to digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.numbers import rounded


def one_of_each_url(rows: DataFrame, url: str = "source_url", order: str = "chunk_id") -> DataFrame:
    """Of rows of one URL the first; partial before it moves."""
    return rows.groupBy(url).agg(F.min_by(F.struct(*(c for c in rows.columns if c != url)), order).alias("_r")).select(url, *(F.col("_r")[c].alias(c) for c in rows.columns if c != url))


def within(rows: DataFrame, start: str, end: str, date: str = "published") -> DataFrame:
    return rows.filter(F.col(date).between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))


def sentiment(rows: DataFrame, key: list[str], most: float = 0.4) -> DataFrame:
    """positive or negative if over `most` of the rows are, and more than of the other; else neutral. Confidence by the number of rows: 5 high, 2 medium."""
    n = F.count(F.lit(1))
    up, down = F.count_if(F.col("sentiment") == "positive") / n, F.count_if(F.col("sentiment") == "negative") / n
    out = rows.groupBy(*key).agg(n.alias("articles"), rounded(up).alias("positive"), rounded(down).alias("negative"))
    mood = F.when((F.col("positive") > most) & (F.col("positive") > F.col("negative")), "positive").when((F.col("negative") > most) & (F.col("negative") > F.col("positive")), "negative").otherwise("neutral")
    return out.withColumn("sentiment", mood).withColumn("confidence", F.when(F.col("articles") >= 5, "high").when(F.col("articles") >= 2, "medium").otherwise("low"))


def by_date(rows: DataFrame, date: str = "published") -> DataFrame:
    return rows.groupBy(date).agg(F.count(F.lit(1)).alias("n"))


def by_domain(rows: DataFrame, url: str = "source_url") -> DataFrame:
    return rows.groupBy(tx.domain(F.col(url)).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def key_points(rows: DataFrame, text: str, newest: int = 10, most: int = 8, least: int = 20) -> DataFrame:
    """First sentences of over `least` characters of the newest rows."""
    new = rows.orderBy(F.desc("published"), "chunk_id").limit(newest)
    return new.select("chunk_id", "published", tx.first_sentence(F.col(text)).alias("point")).filter(F.length("point") > least).orderBy(F.desc("published"), "chunk_id").limit(most)


def summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("company").alias("companies"), F.min("published").alias("first"), F.max("published").alias("last"))


def queries(companies: DataFrame, categories: list[str]) -> DataFrame:
    """What to ask for: each company and category. Categories are a constant."""
    return companies.select("company", F.explode(F.array(*map(F.lit, categories))).alias("category"))


def recency(days: int) -> str:
    """The bucket that a source of news takes for so many days back."""
    return "day" if days <= 1 else "week" if days <= 7 else "month" if days <= 30 else "year"


def with_words(rows: DataFrame, text: str, least: int) -> DataFrame:
    """Rows whose text has at least so many words."""
    return rows.filter(F.size(tx.tokens(F.col(text))) >= least)


def recent_titles(rows: DataFrame, title: str, as_of: str, days: int = 7, most: int = 5) -> DataFrame:
    """Different titles of the last days, the newest first."""
    new = rows.filter(F.col("published").between(F.date_sub(F.to_date(F.lit(as_of)), days), F.to_date(F.lit(as_of)))).filter(F.col(title) != "")
    return new.groupBy(F.col(title).alias("title")).agg(F.max("published").alias("published")).orderBy(F.desc("published"), "title").limit(most)


def topic_report(rows: DataFrame, key: str, start: str, end: str, url: str = "source_url") -> DataFrame:
    """Of a span of days, by key: articles, days with any, sources, first and last day, and the sentiment of most."""
    inside = within(rows, start, end)
    out = inside.groupBy(key).agg(F.count(F.lit(1)).alias("articles"), F.count_distinct("published").alias("days"), F.count_distinct(tx.domain(F.col(url))).alias("sources"), F.min("published").alias("first"), F.max("published").alias("last"))
    return out.join(sentiment(inside, [key]).select(key, "sentiment"), key)


def wrong_span(start: str, end: str, as_of: str, topic: str, topics: list[str], most: int = 730) -> list[str]:
    """What is wrong with a request for news of a span of days, if anything."""
    import datetime

    try:
        a, b, now = map(datetime.date.fromisoformat, (start, end, as_of))
    except ValueError:
        return ["dates: yyyy-mm-dd"]
    found = ["start: after end"] if a > b else []
    found += ["end: in the future"] if b > now else []
    found += [f"span: over {most} days"] if (b - a).days > most else []
    return found + ([] if topic in topics else [f"no such topic: {topic}"])
