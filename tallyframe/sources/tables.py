"""Tables on plain Parquet, with merges; exports; what is known of a table.

A table is a folder of versions. A write makes a whole new version beside the old one and then lists it, so readers see the
old or the new state; the listing is a small Parquet file, read by Spark, hence any store will do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import relational as rel


class Table:
    """A table of a schema and key, partitioned by a column if one is named."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], partition: str | None = None, keep: int = 2):
        self.spark, self.path, self.schema, self.key, self.partition, self.keep = spark, path.rstrip("/"), schema, key, partition, keep

    def _versions(self) -> list[tuple[int, str]]:
        return [(v, folder) for v, folder, _ in self._listed()]

    def _listed(self) -> list[tuple[int, str, int | None]]:
        """(version, folder, batch) of the listing, one row a version."""
        try:
            rows = self.spark.read.schema("version long, folder string, batch long").parquet(f"{self.path}/_versions").collect()
        except AnalysisException:
            return []
        return sorted(((r.version, r.folder, r.batch) for r in rows), key=lambda x: x[0])

    def last_batch(self) -> int | None:
        """The greatest number that write() was given."""
        return max((b for _, _, b in self._listed() if b is not None), default=None)

    def read(self) -> DataFrame:
        found = self._versions()
        return self.spark.read.schema(self.schema).parquet(found[-1][1]) if found else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int | None = None) -> None:
        """df as the new state; with the number of the batch that made it, in the same row of the listing. Only the newest `keep` versions stay."""
        found = self._versions()
        number = found[-1][0] + 1 if found else 0
        folder = f"{self.path}/v{number}-{uuid.uuid4().hex[:8]}"
        writer = df.select(*self.spark.createDataFrame([], self.schema).columns).write
        (writer.partitionBy(self.partition) if self.partition else writer).parquet(folder)
        self.spark.createDataFrame([(number, folder, batch)], "version long, folder string, batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/_versions")
        for _, old in found[: max(0, len(found) + 1 - self.keep)]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def upsert(self, new: DataFrame) -> None:
        self.write(rel.upsert(self.read(), new, self.key))

    def upsert_known(self, new: DataFrame) -> None:
        self.write(rel.upsert_known(self.read(), new, self.key))

    def insert_absent(self, new: DataFrame) -> None:
        self.write(rel.insert_absent(self.read(), new, self.key))

    def delete(self, predicate) -> None:
        """Rows that meet it go (a null predicate keeps a row)."""
        self.write(self.read().filter(~F.coalesce(predicate, F.lit(False))))

    def drop(self) -> None:
        """The table with all its versions."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def info(self, rows: int = 3) -> dict:
        df = self.read()
        return {"schema": df.schema.simpleString(), "rows": df.count(), "versions": len(self._versions()), "sample": [r.asDict() for r in df.limit(rows).collect()]}


def list_tables(spark: SparkSession, root: str) -> list[str]:
    """Names of the tables in a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(path):
        return []
    folders = [s.getPath() for s in system.listStatus(path) if s.isDirectory()]
    return sorted(f.getName() for f in folders if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_versions")))


def export(df: DataFrame, path: str, kind: str = "csv") -> None:
    """csv, json or parquet, written by all tasks; nested columns go into csv as JSON."""
    if kind == "csv":
        nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
        df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)
    elif kind in ("json", "parquet"):
        getattr(df.write.mode("overwrite"), kind)(path)
    else:
        raise ValueError(f"no such form of export: {kind}")


def index_chunks(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Chunks appended to (or written over) an index that is partitioned by ticker; metadata as JSON."""
    nested = [c for c, t in df.dtypes if c == "metadata" and not t.startswith("string")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite" if overwrite else "append").partitionBy("ticker").parquet(path)


def fresh(df: DataFrame, hours: int, as_of: str, column: str = "updated_at") -> DataFrame:
    return df.filter(F.col(column) > F.to_timestamp(F.lit(as_of)) - F.make_dt_interval(hours=F.lit(hours)))
