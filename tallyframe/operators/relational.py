"""Joins, windows, merges and statistics that several parts need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded


def first_of(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


# merges (a table has no MERGE here: the new state of a table is computed, and written over it) ---------------------
def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows go over old ones of the same key; within `new` keys are different."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def upsert_known(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """As upsert(), but a null never goes over a value."""
    o, n = old.alias("o"), new.alias("n")
    on = reduce(lambda a, b: a & b, (F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in key))
    return o.join(n, on, "full").select(*(F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"))


def insert_counts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """inserted, skipped: what insert_absent() would do."""
    seen = new.select(*key).join(old.select(*key).distinct().withColumn("_seen", F.lit(1)), key, "left")
    return seen.agg(F.count_if(F.col("_seen").isNull()).alias("inserted"), F.count_if(F.col("_seen").isNotNull()).alias("skipped"))


def retained(df: DataFrame, date_col: str, cutoff: str) -> DataFrame:
    return df.filter(F.col(date_col) >= F.to_date(F.lit(cutoff)))


def reset(rows: DataFrame, companies: DataFrame, key: str = "cik") -> DataFrame:
    """rows without those of the companies given."""
    return rows.join(companies.select(key).distinct(), key, "left_anti")


def reset_companies(companies: DataFrame, gone: DataFrame, key: str = "cik") -> DataFrame:
    """companies with the time of their last update taken away from those given, so that they are loaded again."""
    marked = companies.join(gone.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return marked.withColumn("updated_at", F.when(F.col("_gone").isNull(), F.col("updated_at"))).select(*companies.columns)


def touched(old: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """upsert() in which rows that are new or differ get `at` as updated_at, and rows that are the same keep theirs."""
    values = [c for c in new.columns if c not in key]
    was = old.select(*key, F.struct(*values).alias("_was"), F.col("updated_at").alias("_at"))
    stamped = new.join(was, key, "left").withColumn("updated_at", F.when(F.struct(*values).eqNullSafe(F.col("_was")), F.col("_at")).otherwise(F.to_timestamp(F.lit(at))))
    return upsert(old, stamped.select(*old.columns), key)


def audit(loads: DataFrame, key: list[str], rows: DataFrame, kind: str, at: str) -> DataFrame:
    """The log of loads (key, kind, n, loaded_at) with what `rows` loads of a kind: the newest load of each key and kind stays."""
    new = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumns({"kind": F.lit(kind), "loaded_at": F.to_timestamp(F.lit(at))})
    return upsert(loads, new.select(*loads.columns), [*key, "kind"])


def tracked(state: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """State of fetched quarters (key, quarters as sorted array) with those of `fetched` (key, quarter)."""
    both = state.select(key, F.explode("quarters").alias("quarter")).unionByName(fetched.select(key, "quarter")).distinct()
    return both.groupBy(key).agg(F.array_sort(F.collect_list("quarter")).alias("quarters"))


# lookups ------------------------------------------------------------------------------------------------------------
#: Rows of a table that may become a constant of the plan.
MOST_CONSTANTS = 10_000


def constants(small: DataFrame) -> Column | None:
    """The rows as an array of structs, if they are at most MOST_CONSTANTS; else None. One row more is read than may be."""
    rows = small.limit(MOST_CONSTANTS + 1).collect()
    if len(rows) > MOST_CONSTANTS:
        return None
    kind = small.schema.simpleString()
    made = [F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in small.schema.fields)) for r in rows]
    return F.array(*made) if made else F.array().cast(f"array<{kind}>")


def with_each(left: DataFrame, small: DataFrame) -> DataFrame:
    """Every row of left with every row of a small table, which becomes a constant of the plan; if it is too large for that, by a shuffled join."""
    each = constants(small)
    return left.crossJoin(small) if each is None else left.select("*", F.inline(each))


def overridden(company: DataFrame, common: DataFrame, name: str = "name") -> DataFrame:
    """A company's definitions (company_id, name, ...), and the common ones that none of its own goes over; for all companies of `company` at once."""
    rest = with_each(company.select("company_id").distinct(), common.drop("company_id"))
    return company.withColumn("priority", F.lit(1)).unionByName(rest.join(company.select("company_id", name), ["company_id", name], "left_anti").withColumn("priority", F.lit(2)))


def scoped(definitions: DataFrame, company_id: int, name: str) -> DataFrame:
    """The definition of a name: the company's, else the common one (null company)."""
    return definitions.filter((F.col("name") == name) & (F.col("company_id").isNull() | (F.col("company_id") == company_id))).orderBy(F.asc_nulls_last("company_id")).limit(1)


def close_pairs(left: DataFrame, right: DataFrame, key: list[str], left_date: str, right_date: str, days: int, shift: int = 0) -> DataFrame:
    """Pairs of a key whose dates are `shift` days apart (the left one later), give or take so many days.

    The range is an equi-join on buckets of days, so matches per key don't grow with the length of the series."""
    width = max(days, 1)
    rows = left.withColumn("_reach", F.floor(F.unix_date(left_date) / width))
    at = F.floor((F.unix_date(right_date) + shift) / width)
    near = right.withColumn("_reach", F.explode(F.sequence(at - 1, at + 1)))
    return rows.join(near, [*key, "_reach"]).drop("_reach").filter(F.abs(F.datediff(left_date, right_date) - shift) <= days)


def fuzzy_dates(left: DataFrame, right: DataFrame, key: list[str], left_date: str, right_date: str, days: int = 5) -> DataFrame:
    """Each left row with the right row of its key on the same date, else the nearest within so many days (a tie goes to the earlier)."""
    return first_of(close_pairs(left, right, key, left_date, right_date, days), [*key, left_date], F.abs(F.datediff(left_date, right_date)), F.col(right_date))


def next_after(left: DataFrame, right: DataFrame, key: list[str], left_date: str, right_date: str) -> DataFrame:
    """Each left row (one of each key and date) with the first right row of its key that is later (inner).

    Both sides run through one window by key, newest first, in which a left row looks back at the last right row; no pairs are made."""
    more = [c for c in right.columns if c not in key]
    both = left.select(*key, F.col(left_date).alias("_at"), F.lit(0).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*more).alias("r")).schema["r"].dataType).alias("_r"))
    there = right.select(*key, F.col(right_date).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), F.struct(*more).alias("_r"))
    newest = Window.partitionBy(*key).orderBy(F.desc("_at"), "_side").rowsBetween(Window.unboundedPreceding, -1)
    met = both.unionByName(there).withColumn("_next", F.last("_r", ignorenulls=True).over(newest)).filter("_side = 0 and _next is not null")
    out = met.select("_l.*", *(F.col(f"_next.{c}").alias(c) for c in more))
    return first_of(out, [*key, left_date], F.col(right_date))


# statistics ---------------------------------------------------------------------------------------------------------
def upper_median(name: str) -> Column:
    """sorted[n // 2] of a column: the lower median of the negated values. Values are counted, not gathered."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{name}`)")


def peer_stats(df: DataFrame, key: list[str], value: str, unit: int = 1_000_000) -> DataFrame:
    """n, highest, lowest, average and upper median (sorted[n // 2]) of each key.

    Equal values are counted first, so a group is never gathered, and the median is where the running count passes the half. The average is of
    whole numbers of 1 / unit, hence the same in any order."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*key, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumns({"_upto": F.sum("_n").over(Window.partitionBy(*key).orderBy("_v")), "_all": F.sum("_n").over(Window.partitionBy(*key))})
    total = F.sum(F.round(F.col("_v") * unit).cast("decimal(38,0)") * F.col("_n").cast("decimal(18,0)")).cast("double")
    n = F.sum("_n")
    median = F.min(F.when(F.col("_upto") > F.floor(F.col("_all") / 2), F.col("_v")))
    return counted.groupBy(*key).agg(n.alias("n"), F.max("_v").alias("highest"), F.min("_v").alias("lowest"), rounded(total / n / unit).alias("average"), median.alias("median"))


def coalesced(df: DataFrame, key: list[str], columns: list[str], *order: Column) -> DataFrame:
    """One row a key: of each column the first value that isn't null, in this order. Partial before it moves."""
    rank = F.struct(*order)
    return df.groupBy(*key).agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns))


def completeness_rows(df: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(F.col(c).isNotNull() & (F.col(c) != 0), 1).otherwise(0) for c in columns))


def best_rows(df: DataFrame, key: list[str], start: str, columns: list[str], *then: Column) -> DataFrame:
    """Of rows of one key that with a start, then with the most values, then by `then`."""
    n = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in columns))
    return first_of(df, key, F.desc(F.col(start).isNotNull()), F.desc(n), *then)
