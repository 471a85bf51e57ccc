"""Streams of events: price bars that are kept up to date, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
BAR = "ticker string, date date, first_id bigint, open_price double, high_price double, low_price double, last_id bigint, close_price double, volume bigint"


def stream(spark: SparkSession, folder: str, files: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", files).parquet(folder)


def bars(events: DataFrame) -> DataFrame:
    """A bar for each user and day; partial before it moves."""
    return events.groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"), F.to_date("ts").alias("date")).agg(
        F.min("event_id").alias("first_id"), F.min_by("value", "event_id").alias("open_price"), F.max("value").alias("high_price"), F.min("value").alias("low_price"),
        F.max("event_id").alias("last_id"), F.max_by("value", "event_id").alias("close_price"), F.count(F.lit(1)).alias("volume"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both: an event that comes late changes its day's bar as if it had come in time."""
    return old.unionByName(new).groupBy("ticker", "date").agg(
        F.min("first_id").alias("first_id"), F.min_by("open_price", "first_id").alias("open_price"), F.max("high_price").alias("high_price"), F.min("low_price").alias("low_price"),
        F.max("last_id").alias("last_id"), F.max_by("close_price", "last_id").alias("close_price"), F.sum("volume").alias("volume"),
    )


def keep_bars(events: DataFrame, table, checkpoint: str) -> StreamingQuery:
    """Each batch of events merged into a Table of bars. One row of the table's listing commits both the bars and the number of the batch, so a batch that is run again after a failure is left out."""

    def run(batch: DataFrame, number: int) -> None:
        done = table.last_batch()
        if done is None or done < number:
            table.write(merged(table.read(), bars(batch)), number)

    return events.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and extremes by event type and window; events later than `late` are left out, copies within it too."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    out = timed.groupBy(F.window("at", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("high"), F.min("value").alias("low"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "high", "low")


def run_to_end(df: DataFrame, out: str, checkpoint: str) -> None:
    """A stream of windows written as Parquet until there is nothing left to read; the last windows stay open."""
    df.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
