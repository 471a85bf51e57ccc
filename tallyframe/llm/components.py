"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, label: str = "components", rows: int | None = None) -> DataFrame:
    """node, label (the smallest node reachable) for every node of edges (a, b) of longs.

    Each round takes the smallest label of all neighbours and then the label of that label, so the rounds are few even
    for long chains. Counts and minima are partial before they move; the joins may be split by AQE. Every round's table
    is written to the shared folder, so a lost executor costs its running tasks. The driver sees one count a round. rows: of edges, if known."""
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), f"{label}-edges", 2 * rows if rows else None)
    rows = both.count()
    labels = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), label, rows)
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = stored(step, label, rows)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = stored(step.join(jump, "label", "left").select("node", "was", F.least("label", "beyond").alias("label")), label, rows)
        moved = after.filter("label <> was").limit(1).count()
        drop_stored(step, labels)
        labels = after.select("node", "label")
        if not moved:
            drop_stored(both)
            return labels
