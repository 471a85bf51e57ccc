"""Periods of companies with other fiscal years, side by side.

A peer group is a value of ratio_name. In each round the newest period that a company has left is its head; the round has a cut, a day, and
takes the heads that aren't before it. Quarters: the cut is so many days before the newest head. Years: heads are taken from the newest down while they are
within so many days of the mean of those taken before, and a round of fewer than two ends it all.

Cuts depend on heads, and heads on the cuts before. So cuts are guessed from the different days of a group, every company runs through them by
itself (its queue is one row), the heads of each round give the cuts that should have been, and that is repeated until they are
the same. A round whose earlier cuts are right gets its right cut, so it ends, after one look where no company has two
periods within the tolerance. What moves are heads (by group and round, partial before they move) and a row of cuts for each group; no task holds a group.

Rows without a date are left out; of a company's periods of one day the one with the smallest value is first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop, written

GROUP = "ratio_name"


def _queues(values: DataFrame) -> DataFrame:
    """A row for each company of a group, with its periods, the newest first."""
    back = (-F.unix_date("period_end_date")).alias("back")
    rows = values.filter("period_end_date is not null").groupBy(GROUP, "ticker").agg(F.array_sort(F.collect_list(F.struct(back, "ratio_value", "period_end_date"))).alias("queue"))
    return rows  # a company's own history of one ratio


def _guess(queues: DataFrame, days: int, most: int | None) -> DataFrame:
    """cuts of each group: so many days before the newest day that is left, over the group's different days (a calendar has no more)."""
    seen = queues.select(GROUP, F.explode("queue.back").alias("back")).distinct().groupBy(GROUP).agg(F.array_sort(F.collect_list("back")).alias("backs"))
    step = lambda cuts, b: F.when((F.size(cuts) == 0) | (-b < F.element_at(cuts, -1)), F.concat(cuts, F.array(-b - days))).otherwise(cuts)
    return seen.select(GROUP, _first(F.aggregate("backs", F.array().cast("array<int>"), step), most).alias("cuts"))


def _first(cuts: Column, most: int | None) -> Column:
    return cuts if most is None else F.slice(cuts, 1, most)


def _run(queue: Column, cuts: Column) -> Column:
    """Heads of a company by round: (round, at: its place in the queue, back, taken); one round more than there are cuts."""
    none = F.array().cast("array<struct<round:int,at:int,back:int,taken:boolean>>")

    def step(state: Column, round_: Column) -> Column:
        at, seen = state["at"], state["seen"]
        back = F.get(queue, at)["back"]
        taken = F.coalesce(-back >= F.get(cuts, round_ - 1), F.lit(False))
        head = F.struct(round_.alias("round"), at.alias("at"), back.alias("back"), taken.alias("taken"))
        return F.when(at < F.size(queue), F.struct((at + taken.cast("int")).alias("at"), F.concat(seen, F.array(head)).alias("seen"))).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.size(cuts) + 1), F.struct(F.lit(0).alias("at"), none.alias("seen")), step, lambda s: s["seen"])


def _quarter_cuts(heads: DataFrame, days: int) -> DataFrame:
    return heads.groupBy(GROUP, "round").agg((F.max(-F.col("back")) - days).alias("cut"))


def _year_cuts(heads: DataFrame, days: int) -> DataFrame:
    """Heads of one day are taken together: the first of them only draws the mean towards the others."""
    counted = heads.groupBy(GROUP, "round", (-F.col("back")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(GROUP, "round").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(GROUP, "round").orderBy(F.desc("day"))
    far = counted.withColumn("far", F.coalesce(F.sum(F.col("n") * F.col("day")).over(before) / F.sum("n").over(before) - F.col("day") > days, F.lit(False)))
    near = far.withColumn("out", F.max("far").over(upto)).filter("not out")
    return near.groupBy(GROUP, "round").agg(F.when(F.sum("n") >= 2, F.min("day")).cast("int").alias("cut"))


def _aligned(values: DataFrame, days: int, most: int | None, next_cuts: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    queues = written(_queues(values))
    cuts = written(_guess(queues, days, most))
    while True:
        heads = queues.join(cuts, GROUP).select(GROUP, F.inline(_run(F.col("queue"), F.col("cuts"))))
        pairs = F.filter(F.array_sort(F.collect_list(F.struct("round", "cut"))), lambda p: p["cut"].isNotNull())
        whole = F.filter(pairs, lambda p, i: p["round"] == i + 1)  # up to the first round without a cut
        found = written(next_cuts(heads, days).groupBy(GROUP).agg(_first(F.transform(whole, lambda p: p["cut"]), most).alias("cuts")))
        same = found.join(cuts.withColumnRenamed("cuts", "were"), GROUP).filter(~F.col("cuts").eqNullSafe(F.col("were"))).isEmpty()
        drop(cuts)
        cuts = found
        if same:
            break
    taken = queues.join(cuts, GROUP).select(GROUP, "ticker", F.explode(F.filter(_run(F.col("queue"), F.col("cuts")), lambda h: h["taken"])).alias("h"), "queue")
    rows = taken.select(GROUP, F.col("h.round").alias("period_number"), "ticker", F.get("queue", F.col("h.at")).alias("p")).select(GROUP, "period_number", "ticker", "p.period_end_date", "p.ratio_value")
    center = rows.groupBy(GROUP, "period_number").agg(F.date_from_unix_date((F.sum(F.unix_date("period_end_date")) / F.count(F.lit(1))).cast("int")).alias("center"))
    return rows.join(center, [GROUP, "period_number"]).select(GROUP, "period_number", "center", "ticker", "period_end_date", "ratio_value")


def cluster_quarters(values: DataFrame, days: int = 45, most: int | None = None) -> DataFrame:
    """Quarters of a peer group (ratio_name, ticker, period_end_date, ratio_value) side by side: all, or the `most` newest for a request of the last n.

    The newest period left is the anchor; of each company the newest period left is taken, if it is within so many days of it."""
    return _aligned(values, days, most, _quarter_cuts)


def align_years(values: DataFrame, days: int = 180, most: int | None = None) -> DataFrame:
    """Fiscal years of a peer group side by side: all, or the `most` newest for a request of the last n."""
    return _aligned(values, days, most, _year_cuts)


def summaries(aligned: DataFrame) -> DataFrame:
    """A row for each period: how many companies, the lowest, highest and mean value, the first and last date; nothing is gathered."""
    value = F.col("ratio_value")
    return aligned.groupBy(GROUP, "period_number", "center").agg(F.count(F.lit(1)).alias("companies"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.avg(value.cast("decimal(38,6)")).cast("double").alias("mean"), F.min("period_end_date").alias("first"), F.max("period_end_date").alias("last"))


def by_period(aligned: DataFrame) -> DataFrame:
    """A row for each period with all companies' values, for charts: the answer itself is as long as the group."""
    return aligned.groupBy(GROUP, "period_number", "center").agg(F.array_sort(F.collect_list(F.struct("ticker", "period_end_date", "ratio_value"))).alias("values"))
