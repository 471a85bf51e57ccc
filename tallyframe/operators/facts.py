"""Filed facts (one value of one tag) to statements (one row a period)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import COMPUTED, TAGS, UNITS


def exploded(filings: DataFrame, cik_col: str = "cik", json_col: str = "facts") -> DataFrame:
    """cik, tag, unit and the fields of each fact, of nested JSON {tag: {units: {unit: [facts]}}}."""
    kind = "map<string, struct<units: map<string, array<struct<start: date, end: date, filed: date, form: string, fp: string, fy: int, val: double, frame: string>>>>>"
    tags = filings.select(cik_col, F.explode(F.from_json(json_col, kind)).alias("tag", "body"))
    return tags.select(cik_col, "tag", F.explode("body.units").alias("unit", "facts")).select(cik_col, "tag", "unit", F.inline("facts"))


def months_of(days: Column) -> Column:
    """Length of a period of so many days, in months."""
    return F.when(days > 330, 12).when(days > 240, 9).when(days > 150, 6).otherwise(3)


def usable(facts: DataFrame) -> DataFrame:
    """Facts of known units with an end and a filing date, with period_length_months and period_type (a year that is too short is a Q4), and a start (made up from the length if there is none)."""
    out = facts.filter(F.col("unit").isin(UNITS) & F.col("end").isNotNull() & F.col("filed").isNotNull())
    months = F.when(F.col("start").isNull(), F.when(F.col("fp") == "FY", 12).otherwise(3)).otherwise(months_of(F.datediff("end", "start")))
    out = out.withColumn("period_length_months", months)
    out = out.withColumn("period_type", F.when(F.col("period_length_months") == 12, "FY").when(F.col("fp") == "FY", "Q4").otherwise(F.coalesce("fp", F.concat(F.lit("Q"), F.quarter("end").cast("string")))))
    return out.withColumn("start", F.coalesce("start", F.add_months("end", -F.col("period_length_months"))))


def mapped(facts: DataFrame, tags: dict[str, str] = TAGS) -> DataFrame:
    """Facts with the column that their tag is filed for, upper and lower case alike. The map is a constant of the plan."""
    lower = {k.lower(): v for k, v in tags.items()}
    pairs = F.create_map(*(F.lit(x) for kv in lower.items() for x in kv))
    return facts.withColumn("column", F.element_at(pairs, F.lower("tag"))).filter("column is not null")


def pivoted(facts: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """A row for each period with a column for each item; of several values the largest. Counts and maxima are partial before they move."""
    return facts.groupBy(*key).agg(*(F.max(F.when(F.col("column") == c, F.col("val"))).alias(c) for c in columns))


def one_year(rows: DataFrame) -> DataFrame:
    """The fiscal year of the oldest filing of a period, for all filings of that period."""
    w = Window.partitionBy("cik", "end", "period_length_months").orderBy("filed", "fy").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.withColumn("fiscal_year", F.first("fy", ignorenulls=True).over(w))


def preferred(facts: DataFrame, key: list[str], latest: bool = False) -> DataFrame:
    """Of several facts of one column and period: one that was filed goes before one that was computed, then the oldest (or latest) filing."""
    rank = F.struct(F.col("computed"), -F.unix_date("filed") if latest else F.unix_date("filed"), F.col("val"))
    return facts.groupBy(*key, "column").agg(F.min_by("val", rank).alias("val"), F.min_by("computed", rank).alias("computed"))


def computed(wide: DataFrame, table: dict[str, list[tuple[str, list[str]]]] = COMPUTED) -> DataFrame:
    """wide (a column for each tag) with the columns that the table can compute; all inputs of an alternative are needed."""
    made = {}
    for name, ways in table.items():
        options = []
        for operation, tags in ways:
            if all(t in wide.columns for t in tags):
                value = F.col(tags[0])
                for t in tags[1:]:
                    value = value + F.col(t) if operation == "add" else value - F.col(t)
                options.append(value)
        if options:
            made[name] = F.coalesce(*([F.col(name)] if name in wide.columns else []), *options)
    return wide.withColumns(made)


def coverage(facts: DataFrame, tags: dict[str, str] = TAGS) -> DataFrame:
    """column, its tags, and the number of facts of each, for columns with more than one tag in use."""
    used = mapped(facts, tags)
    return used.groupBy("column").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.count(F.lit(1)).alias("n")).filter("size(tags) > 1")


def value_at(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (cik, tag, end, filed, months) with the value filed for it: of the first unit that has one; of several facts the one whose length is the months asked for, give or take one (30.44 days each), else the first by start."""
    met = facts.join(asked, ["cik", "tag", "end", "filed"]).filter(F.col("unit").isin(UNITS) & F.col("val").isNotNull())
    unit = F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit"))
    off = F.abs(F.round(F.datediff("end", "start") / 30.44) - F.col("months"))
    best = met.groupBy("cik", "tag", "end", "filed", "months").agg(F.min_by("val", F.struct(unit, F.coalesce(off > 1, F.lit(True)), F.coalesce("start", F.to_date(F.lit("0001-01-01"))), "val")).alias("val"))
    return best
