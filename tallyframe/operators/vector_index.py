"""An index of vectors by coarse cells, with exact re-ranking.

Cells are the nearest of some centroids, which are fitted on a sample of bounded size; every row is in the index. A search compares a query with the rows of
its nearest cells, exactly; with all cells it is the exact search. Large cells are dealt into parts, so a group has a bounded number of rows, however many
copies a vector has; queries meet a group in one task, of each query k rows leave it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows on which centroids are fitted (those whose ids hash lowest), rows a centroid of that sample at least, rounds of the fit, rows of a part of a cell.
SAMPLE, ROWS_A_CENTROID, ROUNDS, PART = 20_000, 20, 12, 4096
ROW = "qid long, id long, score double"


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray

    def rows(self) -> DataFrame:
        """cell, part, id, vector; sorted by cell within each file."""
        return self.spark.read.parquet(self.path)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, the nearest first."""
    far = (centroids**2).sum(1)[None, :] - 2 * x @ centroids.T
    if n >= len(centroids):
        return np.argsort(far, axis=1, kind="stable")
    near = np.argpartition(far, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)


def fitted(sample: np.ndarray, n: int, seed: int = 5) -> np.ndarray:
    """n centroids of the sample: Lloyd's rounds from different rows; an empty cell starts again at a row."""
    r = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0)
    n = min(n, len(sample))
    centroids = sample[r.choice(len(sample), n, replace=False)] if n else sample
    for _ in range(ROUNDS if n > 1 else 0):
        cell = _nearest(sample, centroids, 1)[:, 0]
        counts = np.bincount(cell, minlength=n)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], sample[r.integers(0, len(sample), n)])
    return centroids


def build(rows: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
    """The index of rows (id, vector), written to a folder; null vectors aren't in it. cells: about the root of the number of rows, as far as the sample can tell so many apart."""
    own = rows.filter("vector is not null").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    n = own.count()
    sample = [r["vector"] for r in own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]
    cells = cells or max(1, min(round(n**0.5), len(sample) // ROWS_A_CENTROID))
    centroids = fitted(np.array(sample, np.float64), cells) if sample else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell = _nearest(_matrix(batch.column(1)), centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], ["cell", "id", "vector"])

    assigned = own.mapInArrow(assign, "cell int, id long, vector array<double>")
    assigned.repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").write.mode("overwrite").parquet(path)
    return VectorIndex(rows.sparkSession, path, centroids)


def _ranked(k: int):
    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(held) and len(asked):
            ids, x = np.asarray(held["id"].combine_chunks()), _matrix(held["vector"])
            for qid, q in zip(asked["qid"].to_pylist(), _matrix(asked["query"]), strict=True):
                score = np.floor(-((x - q) ** 2).sum(1) * 1e6 + 0.5) / 1e6
                few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
                best = few[np.lexsort((ids[few], -score[few]))[:k]]
                out.append((np.full(len(best), qid), ids[best], score[best]))
        kinds = (np.int64, np.int64, np.float64)
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]).astype(kinds[i]) if out else np.empty(0, kinds[i])) for i, n in enumerate(("qid", "id", "score"))})

    return run


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = 8) -> DataFrame:
    """qid, id, score (negative squared distance), place: of queries (qid, vector) the k best rows of their `probes` nearest cells; None: of all cells, which is exact. A tie goes by id."""
    centroids, n = index.centroids, len(index.centroids)
    probes = n if probes is None else min(probes, n)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                cell = _nearest(_matrix(batch.column(1)), centroids, probes).astype(np.int32)
                of = pa.array(np.repeat(np.arange(len(batch)), probes))
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), batch.column(0).take(of), batch.column(1).take(of)], ["cell", "qid", "query"])

    own = queries.filter("vector is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    rows = index.rows()
    parts = rows.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))  # a row a cell
    held = rows.join(parts, F.col("cell") == F.col("of")).select("cell", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "parts").cast("int").alias("part"), "id", "vector")
    aimed = own.mapInArrow(aim, "cell int, qid long, query array<double>") if n else own.limit(0).select(F.lit(0).alias("cell"), "qid", F.col("vector").alias("query"))
    asked = aimed.join(parts, F.col("cell") == F.col("of")).select(F.col("cell").alias("at_cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("at_part"), "qid", "query")
    found = held.groupBy("cell", "part").cogroup(asked.groupBy("at_cell", "at_part")).applyInArrow(_ranked(k), ROW)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= k)


#: Queries on which probes_for() looks.
TRIED = 200


def probes_for(index: VectorIndex, queries: DataFrame, k: int, share: float = 0.95) -> int:
    """How many cells a search has to look at to find this share of the exact k best: the quantile of the places that the cells of exact results have for their queries, of TRIED queries (those whose ids hash lowest)."""
    few = queries.filter("vector is not null").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("query")).orderBy(F.xxhash64("qid"), "qid").limit(TRIED)
    exact = search(index, few.withColumnRenamed("query", "vector"), k, None).select("qid", "id")
    rows = exact.join(index.rows().select("id", "cell"), "id").join(few, "qid").select("query", "cell").collect()  # TRIED * k
    if not rows:
        return 1
    order = _nearest(np.array([r["query"] for r in rows], np.float64), index.centroids, len(index.centroids))
    places = (order == np.array([r["cell"] for r in rows])[:, None]).argmax(1)
    return int(np.quantile(places, share, method="higher")) + 1


def recall(index: VectorIndex, queries: DataFrame, k: int, probes: int) -> float:
    """Share of the exact k best that the search by cells finds."""
    exact, found = search(index, queries, k, None), search(index, queries, k, probes)
    n = exact.count()
    return exact.join(found, ["qid", "id"], "left_semi").count() / n if n else 1.0
