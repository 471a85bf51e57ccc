"""Tables that grow by batches, several of them together.

A batch writes a folder in each table and then one line in a list of batches. Readers read the folders of listed batches only, so a batch is there in all tables or
in none; a run that ends half-way leaves folders that nobody reads, and the next run of the batch writes over them. A batch
that is listed isn't written again. Each table is plain Parquet, written by all tasks; the list is Parquet too, so any store will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException


class Batches:
    """Tables of the schemas given, in a folder."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas

    def committed(self) -> list[str]:
        """Names of the batches that are there."""
        try:
            return sorted(r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/_batches").distinct().collect())  # a row a batch
        except AnalysisException:
            return []

    def read(self, table: str) -> DataFrame:
        """Rows of a table, with the batch that wrote each."""
        schema = f"{self.schemas[table]}, batch string"
        folders = [f"{self.path}/{table}/batch={b}" for b in self.committed()]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def commit(self, batch: str, **tables: DataFrame) -> bool:
        """Writes the batch, a frame for each table; False, and nothing is written, if it is there already."""
        if missing := set(self.schemas) ^ set(tables):
            raise ValueError(f"a batch has all tables and no others: {sorted(missing)}")
        if batch in self.committed():
            return False
        for name, df in tables.items():
            columns = self.spark.createDataFrame([], self.schemas[name]).columns
            df.select(*columns).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(f"{self.path}/_batches")
        return True
