"""Summaries and checks of companies, catalogs and indexes."""

from __future__ import annotations

import ast
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import RATIOS, VIRTUAL
from ..functions.numbers import or_zero, ratio, rounded
from .filings import statement_of
from .relational import close_pairs, constants, first_of, next_after


def company_summary(statements: DataFrame) -> DataFrame:
    """A row for each company: rows, first and last date, share with revenue, kinds of periods."""
    return statements.groupBy("cik", "ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.min("period_end_date").alias("first"), F.max("period_end_date").alias("last"), rounded(F.count_if((F.col("total_revenue").isNotNull()) & (F.col("total_revenue") != 0)) / F.count(F.lit(1))).alias("revenue_coverage"),
        F.count_distinct("period_type").alias("period_types"), F.count_if(F.col("period_type") == "FY").alias("years"),
    )


def problems(summary: DataFrame, least_rows: int = 4, least_coverage: float = 0.5) -> DataFrame:
    """What is wrong with a company's data, as an array; companies without problems are left out."""
    found = F.array(F.when(F.col("rows") < least_rows, "few rows"), F.when(F.col("revenue_coverage") < least_coverage, "little revenue"), F.when(F.col("years") == 0, "no year"))
    return summary.select("cik", "ticker", F.filter(found, lambda x: x.isNotNull()).alias("problems")).filter("size(problems) > 0")


def latest(rows: DataFrame, key: list[str], date: str, *values: str) -> DataFrame:
    """Values of the latest row of each key; partial before it moves."""
    return rows.groupBy(*key).agg(F.max(date).alias(date), *(F.max_by(v, date).alias(v) for v in values))


def adhoc(statements: DataFrame, name: str, plus: list[str], minus: list[str] | None = None) -> DataFrame:
    """A metric a + b - c in which null counts as 0."""
    total = reduce(lambda a, b: a + b, map(or_zero, plus))
    return statements.withColumn(name, reduce(lambda a, b: a - b, map(or_zero, minus or []), total))


def nested(ratios: DataFrame, key: list[str]) -> DataFrame:
    """category -> {ratio: value} of each period; a period has a few dozen ratios."""
    inner = ratios.groupBy(*key, "category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ratio_name", "ratio_value")))).alias("ratios"))
    return inner.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.to_json("ratios"))))).alias("categories"))


def by_definition(asked: DataFrame, definitions: DataFrame) -> DataFrame:
    """The definition meant by each name asked: equal (in any case), else the shortest that holds the name. The catalog is a constant of the plan."""
    tier = lambda name: F.when(F.lower("asked") == F.lower(name), 0).when(F.lower(name).contains(F.lower("asked")), 1)
    each = constants(definitions)
    if each is None:  # too many for a constant
        met = asked.crossJoin(definitions).withColumn("tier", tier(F.col("ratio_name"))).filter("tier is not null")
        return first_of(met, ["asked"], F.col("tier"), F.length("ratio_name"), F.col("ratio_name"))
    ranked = F.transform(each, lambda d: F.struct(tier(d["ratio_name"]).alias("tier"), F.length(d["ratio_name"]).alias("size"), d["ratio_name"].alias("name"), d.alias("d")))
    best = asked.withColumn("_b", F.array_min(F.filter(ranked, lambda x: x["tier"].isNotNull()))).filter("_b is not null")
    return best.select(*asked.columns, *(F.col(f"_b.d.{c}").alias(c) for c in definitions.columns), F.col("_b.tier").alias("tier"))


def drift(catalog: DataFrame, stored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Names (or other keys) whose formula differs between catalog and table, with both formulas; null where it isn't there."""
    key = key or ["ratio_name"]
    both = catalog.select(*key, F.col("formula").alias("wanted")).join(stored.select(*key, F.col("formula").alias("found")), key, "full")
    return both.filter(~F.col("wanted").eqNullSafe(F.col("found")))


def missing_years(index: DataFrame, key: list[str], first: int, last: int) -> DataFrame:
    """Expected years of each key of which the index has no yearly report, as an array; keys that lack none are left out."""
    years = F.collect_set(F.when(F.col("form_type") == "10-K", F.col("fiscal_year").cast("int")))
    out = index.groupBy(*key).agg(F.array_sort(F.array_except(F.sequence(F.lit(first), F.lit(last)), years)).alias("missing"))
    return out.filter("size(missing) > 0")


#: Own words for what a group of ratios is about.
ABOUT = {"profitability": "earning power", "liquidity": "means to pay what is due soon", "leverage": "weight of borrowed money", "efficiency": "pace at which means are put to work", "growth": "change over a year", "valuation": "price of the shares", "cash_flow": "cash behind the figures"}


def spelled(node: ast.expr) -> str:
    """A formula's tree in words."""
    if isinstance(node, ast.BinOp):
        word = {ast.Div: "over", ast.Mult: "times", ast.Add: "plus", ast.Sub: "less"}[type(node.op)]
        return f"{spelled(node.left)} {word} {spelled(node.right)}"
    if isinstance(node, ast.UnaryOp):
        return f"minus {spelled(node.operand)}"
    if isinstance(node, ast.Call):
        return f"{node.func.id.lower().replace('_', ' ')} of {', '.join(map(spelled, node.args))}"
    return str(node.value) if isinstance(node, ast.Constant) else node.id.replace("_", " ")


def explained(category: str, formula: str) -> str:
    """What a ratio says, from its own formula and group."""
    return f"{ABOUT.get(category, category.replace('_', ' ')).capitalize()}: {spelled(ast.parse(formula, mode='eval').body)}."


SAYS = {name: explained(category, formula) for name, category, formula in RATIOS}


def interpretation(name: Column) -> Column:
    """What a ratio of the catalog says, null for others. The texts are constants of the plan, made from the formulas."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in SAYS.items() for x in kv)), name)


def guidance(definitions: DataFrame, name: str = "ratio_name", formula: str = "formula") -> DataFrame:
    """How each ratio is worked out: a row for each field of its formula, with the statement that it is read from, or virtual if it is worked out itself. Fields are the words of the formula that aren't functions."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.col(formula), F.lit(r"([A-Za-z_][\w&]*)(\s*\()?"), F.lit(0)), lambda w: ~w.endswith("(")))
    own = definitions.select(*definitions.columns, F.explode(words).alias("field"))
    return own.withColumn("read_from", F.when(F.col("field").isin(*VIRTUAL), "virtual").otherwise(statement_of(F.col("field"))))


def consecutive_growth(years: DataFrame, value: str) -> DataFrame:
    """Growth over the year before, where that is the year just before."""
    w = Window.partitionBy("cik").orderBy("fiscal_year")
    out = years.withColumns({"_year": F.lag("fiscal_year").over(w), "_was": F.lag(value).over(w)})
    change = rounded(ratio(F.col(value) - F.col("_was"), F.col("_was")))
    return out.filter("_year = fiscal_year - 1").select("cik", "fiscal_year", change.alias("growth")).filter("growth is not null")


def quarter_order(label: Column) -> tuple[Column, Column]:
    """Year and quarter of a label like Q4-2022 or 2022Q4, to sort by (null if it is neither)."""
    year = F.coalesce(F.regexp_extract(label, r"^Q[1-4]-(\d{4})$", 1).try_cast("int"), F.regexp_extract(label, r"^(\d{4})Q[1-4]$", 1).try_cast("int"))
    return year, F.regexp_extract(label, r"Q([1-4])", 1).try_cast("int")


def corrected_years(filings: DataFrame, facts: DataFrame, years: DataFrame, days: int = 5) -> DataFrame:
    """Filings with the fiscal year of the fact filed on the same date, or else within so many days; a quarter's year is at most that of the next yearly report.

    filings: cik, form_type, filed, fiscal_year; facts: cik, fact_filed, fact_year; years: cik, year_filed, year."""
    near = close_pairs(filings, facts, ["cik"], "filed", "fact_filed", days)
    best = near.groupBy("cik", "form_type", "filed").agg(F.min_by("fact_year", F.struct(F.abs(F.datediff("fact_filed", "filed")), "fact_filed", "fact_year")).alias("fact_year"))
    caps = years.groupBy("cik", "year_filed").agg(F.min("year").alias("cap"))
    after = next_after(filings.filter("form_type = '10-Q'").select("cik", "form_type", "filed").distinct(), caps, ["cik"], "filed", "year_filed").select("cik", "form_type", "filed", "cap")
    out = filings.join(best, ["cik", "form_type", "filed"], "left").join(after, ["cik", "form_type", "filed"], "left")
    return out.withColumn("corrected", F.least(F.coalesce("fact_year", "fiscal_year"), F.coalesce("cap", F.coalesce("fact_year", "fiscal_year")))).drop("fact_year", "cap")
