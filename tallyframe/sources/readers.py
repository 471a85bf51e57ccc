"""Readers of landed files. Nothing is fetched from a network: what a service would answer is read where it was landed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = "struct<start: date, end: date, filed: date, form: string, fp: string, fy: int, val: double, frame: string>"
FACTS = f"cik string, entityName string, facts struct<`us-gaap`: map<string, struct<units: map<string, array<{FACT}>>>>>"
INFO = "cik string, name string, tickers array<string>, sic string, sicDescription string, ein string, description string, website string, category string, fiscalYearEnd string, stateOfIncorporation string"
PRICE = "ticker string, date date, open_price decimal(12,4), high_price decimal(12,4), low_price decimal(12,4), close_price decimal(12,4), adjusted_close decimal(12,4), volume bigint, source string"
TRANSCRIPT = "ticker string, quarter string, transcript array<struct<speaker: string, title: string, content: string, sentiment: string>>"


def padded_cik(cik: Column) -> Column:
    """A CIK as ten digits; longer ones stay, anything but digits is null."""
    text = F.trim(cik.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), F.when(F.length(text) < 10, F.lpad(text, 10, "0")).otherwise(text))


def clean_ticker(ticker: Column) -> Column:
    """Upper case, trimmed, 1 to 10 letters, digits, points and dashes; else null."""
    text = F.upper(F.trim(ticker))
    return F.when(text.rlike("^[A-Z0-9.-]{1,10}$"), text)


def company_facts(spark: SparkSession, path: str) -> DataFrame:
    """cik, tag, unit and the fields of each fact of landed company-facts JSON (one document a file)."""
    raw = spark.read.schema(FACTS).option("multiLine", True).json(path)
    tags = raw.select(padded_cik(F.col("cik")).alias("cik"), F.col("entityName").alias("entity_name"), F.explode("facts.us-gaap").alias("tag", "body"))
    return tags.select("cik", "entity_name", "tag", F.explode("body.units").alias("unit", "values")).select("cik", "entity_name", "tag", "unit", F.inline("values"))


def company_info(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(INFO).option("multiLine", True).json(path)
    return raw.withColumn("cik", padded_cik(F.col("cik"))).withColumn("ticker", F.element_at("tickers", 1))


def with_cik(rows: DataFrame, dimension: DataFrame, ticker: str = "ticker") -> DataFrame:
    """rows with the CIK of their ticker: as it is written, else without a point or dash. The dimension has a row a ticker."""
    known = dimension.select(clean_ticker(F.col("ticker")).alias("_ticker"), padded_cik(F.col("cik")).alias("_cik"))
    loose = known.select(F.regexp_replace("_ticker", "[.-]", "").alias("_loose"), "_cik").groupBy("_loose").agg(F.min("_cik").alias("_loose_cik"))
    own = rows.withColumn("_t", clean_ticker(F.col(ticker)))
    out = own.join(known, F.col("_t") == F.col("_ticker"), "left").join(loose, F.regexp_replace("_t", "[.-]", "") == F.col("_loose"), "left")
    return out.withColumn("cik", F.coalesce("_cik", "_loose_cik")).drop("_t", "_ticker", "_cik", "_loose", "_loose_cik")


def filings(spark: SparkSession, path: str) -> DataFrame:
    """path, and the whole text of each landed filing."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def filing_files(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified, and the year in the name; contents aren't read."""
    from ..functions.fiscal import filing_date_of

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return files.withColumn("filing_date", filing_date_of(F.col("path")))


def recent_filings(files: DataFrame, years: int, as_of: str, date: str = "filing_date") -> DataFrame:
    """Files of the last years; those of unknown date stay."""
    return files.filter(F.col(date).isNull() | (F.col(date) >= F.add_months(F.to_date(F.lit(as_of)), -12 * years)))


def filing_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"))


#: Header lines of filings, name and pattern.
HEADER = {
    "company_name": r"COMPANY CONFORMED NAME:\s*([^\r\n]+)",
    "form_type": r"CONFORMED SUBMISSION TYPE:\s*([^\r\n]+)",
    "period_end": r"CONFORMED PERIOD OF REPORT:\s*(\d{8})",
    "filed": r"FILED AS OF DATE:\s*(\d{8})",
    "cik": r"CENTRAL INDEX KEY:\s*(\d+)",
    "fiscal_year_end": r"FISCAL YEAR END:\s*(\d{4})",
}


def filing_headers(texts: DataFrame, text: str = "text") -> DataFrame:
    """With a column for each line of a filing's header; null where it is missing. Dates are dates, the fiscal year that of the period's end."""
    from ..functions.fiscal import year_of

    found = {n: F.trim(F.nullif(F.regexp_extract(F.col(text), p, 1), F.lit(""))) for n, p in HEADER.items()}
    out = texts.withColumns(found).withColumns({n: F.try_to_date(n, "yyyyMMdd") for n in ("period_end", "filed")}).withColumn("cik", padded_cik(F.col("cik")))
    return out.withColumn("fiscal_year", F.coalesce(year_of(F.col("period_end"), F.col("fiscal_year_end")), F.year("period_end")))


def document_body(text: Column) -> Column:
    """The first document of a submission, without its wrapper, also if it is empty; without a wrapper the whole text."""
    body = F.regexp_extract(text, r"(?s)<TEXT>(.*?)</TEXT>", 1)
    return F.when((body != "") | text.contains("<TEXT></TEXT>"), body).otherwise(text)


def prices(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    reader = spark.read.schema(PRICE)
    return reader.csv(path, header=True) if kind == "csv" else reader.json(path)


def with_fallback(primary: DataFrame, backup: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the primary source, and those of the backup that it lacks."""
    return primary.unionByName(backup.join(primary.select(*key), key, "left_anti"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """ticker, quarter, seq, speaker, title and content of landed transcript JSON."""
    raw = spark.read.schema(TRANSCRIPT).json(path)
    return raw.select("ticker", "quarter", F.posexplode("transcript").alias("seq", "e")).select("ticker", "quarter", "seq", "e.*")


@dataclass
class Registry:
    """Sources by name, and which of them is the default."""

    sources: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    default: str | None = None

    def register(self, name: str, read: Callable[..., DataFrame], default: bool = False) -> None:
        self.sources[name] = read
        if default or self.default is None:
            self.default = name

    def read(self, spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
        chosen = name or self.default
        if chosen not in self.sources:
            raise KeyError(f"no source {chosen!r}; there are {sorted(self.sources)}")
        return self.sources[chosen](spark, path)


TRANSCRIPT_SOURCES = Registry()
TRANSCRIPT_SOURCES.register("landed", transcripts, default=True)
