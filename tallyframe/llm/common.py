"""What the operators of this subpackage share: table access, shared scratch tables, exact thresholds, components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.workers import _settle, kept_by, mapped  # noqa: F401  (the operators of this subpackage take them from here)

#: Characters that part words: space and the control characters 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; only a local session may fall back to a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tallyframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Names of the folders that stored() made and drop_stored() hasn't deleted.
_made: set[str] = set()


#: Rows of a file of a table of short rows, and the least number of its files.
FILE_ROWS, LEAST_FILES = 50_000, 12


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read back: this cuts the lineage, and a lost executor costs nothing but its running tasks.

    rows: at most so many short ones are expected, so the last stage needs no more tasks than files of FILE_ROWS: tables of a few rows in hundreds of files cost more to open than to read."""
    df = df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // FILE_ROWS)))
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/tallyframe/{name}"
    df.write.parquet(path)
    _made.add(name)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the folders of tables from stored() that nothing reads any more; other tables are left alone."""
    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if (name := folder.rsplit("/", 1)[-1]) in _made:
                _made.remove(name)
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def uniform(*cols: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols, F.lit(seed)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def sortable(value: Column) -> Column:
    """A double as a long in 0..2**62 of the same order (NaN is not allowed; differences below 2**-20 of the range -2**41..2**41 merge)."""
    clipped = F.greatest(F.least(value, F.lit(2.0**41)), F.lit(-(2.0**41)))
    return (F.floor((clipped + F.lit(2.0**41)) * F.lit(2.0**20))).cast("long")


def kth_largest(keys: DataFrame, column: str, k: int, bits: int = 62, step: int = 16) -> int | None:
    """The k-th largest value of a column of longs in 0..2**bits, exactly. Each round counts by the next `step` bits, so the driver sees 2**step rows at most.

    None for k = 0 or an empty table; the smallest value if k is larger than the table. Nulls don't count."""
    if k <= 0:
        return None
    prefix, known = 0, 0
    while known < bits + 1:
        take = min(step, bits + 1 - known)
        rest = bits + 1 - known - take
        level = keys.filter(F.shiftright(F.col(column), bits + 1 - known) == F.lit(prefix)) if known else keys.filter(F.col(column).isNotNull())
        counts = level.groupBy(F.shiftright(F.col(column), rest).alias("p")).count().orderBy(F.desc("p")).collect()
        if not counts:
            return None
        for row in counts:
            prefix = row["p"]
            if k <= row["count"]:
                break
            k -= row["count"]
        else:
            k = counts[-1]["count"]
        known += take
    return prefix


def best(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column) -> DataFrame:
    """The first k rows of each key with their rank. Rows are first cut to k in each of SPREAD parts of a key (by `spread`), so no task gets all rows of a key, however many tasks found some."""
    cut = df.withColumn("part_of_key", F.pmod(spread, F.lit(SPREAD)))
    for names in ([*keys, "part_of_key"], keys):
        cut = cut.withColumn("rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order))).filter(F.col("rank") <= k)
    return cut.drop("part_of_key")


#: Parts into which best() and merged sums deal what the tasks of a job found for one key.
SPREAD = 256


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id long, x array of longs: floor(scale * component) of the vectors that are whole (not null, no null or non-finite component). Beyond the range of longs x stays at its end."""
    vector = F.col(vector_col).cast("array<double>")
    whole = F.col(vector_col).isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df.filter(F.coalesce(whole, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda c: F.floor(c * F.lit(float(scale)))).alias("x"))


def as_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of longs; shorter vectors are filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out
