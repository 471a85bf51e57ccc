"""Tables that are written by partition: a merge rewrites the partitions that it touches, and no other file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import relational as rel
from .scratch import drop, written


class Partitioned:
    """A table of a schema in a folder, with a folder for each value of `by`, which is part of the key: equal keys never lie in different partitions.

    What a merge makes of the touched partitions is written beside the table first, then over them, so the merge can be run again after a failure
    and gives the same. Other partitions are neither read nor written."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], by: str):
        if by not in key:
            raise ValueError(f"{by} has to be part of the key")
        self.spark, self.path, self.schema, self.key, self.by = spark, path.rstrip("/"), schema, key, by

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def _merge(self, new: DataFrame, merge) -> None:
        new = written(new.select(*self.spark.createDataFrame([], self.schema).columns))
        values = [r[0] for r in new.select(self.by).distinct().collect()]  # a value a folder
        if any(v is None for v in values):
            raise ValueError(f"a row without {self.by}")
        if values:
            made = written(merge(self.read().filter(F.col(self.by).isin(values)), new, self.key))
            made.repartition(self.by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.by).parquet(self.path)
            drop(made)
        drop(new)

    def upsert(self, new: DataFrame) -> None:
        """Rows of new go over those of their key."""
        self._merge(new, rel.upsert)

    def upsert_known(self, new: DataFrame) -> None:
        """The same, but a null never goes over a value."""
        self._merge(new, rel.upsert_known)

    def insert_absent(self, new: DataFrame) -> None:
        self._merge(new, rel.insert_absent)
