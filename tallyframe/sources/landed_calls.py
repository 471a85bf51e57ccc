"""A Spark data source of landed calls: spark.read.format("landed_calls").load(folder).

A folder holds files ticker=<ticker>/fiscal_year=<year>/*.json, a turn a line. A file is a partition of the read; filters on ticker
and fiscal_year (equal, in, and years greater or less) choose files before any is opened. Files are listed and read by pyarrow, so any of its file systems will do."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.json
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

SCHEMA = "ticker string, fiscal_year int, quarter int, seq int, speaker string, content string"
LINE = pa.schema([("quarter", pa.int32()), ("seq", pa.int32()), ("speaker", pa.string()), ("content", pa.string())])
TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    IsNotNull: lambda v, f: True,
}


class LandedFile(InputPartition):
    def __init__(self, path: str, ticker: str, fiscal_year: int):
        self.path, self.ticker, self.fiscal_year = path, ticker, fiscal_year


class Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder, self.taken = folder, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on the two columns that folders are named by; Spark keeps the others."""
        for f in filters:
            if type(f) in TESTS and f.attribute in (("ticker",), ("fiscal_year",)):
                self.taken.append(f)
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        system, root = fs.FileSystem.from_uri(self.folder)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            named = dict(p.split("=", 1) for p in info.path.split("/") if "=" in p)
            if info.is_file and info.size and info.path.endswith(".json") and {"ticker", "fiscal_year"} <= set(named):
                values = {"ticker": unquote(named["ticker"]), "fiscal_year": int(named["fiscal_year"])}
                if all(TESTS[type(f)](values[f.attribute[0]], f) for f in self.taken):
                    out.append(LandedFile(info.path, **values))
        return out

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(partition.path) as file:
            rows = pyarrow.json.read_json(file, parse_options=pyarrow.json.ParseOptions(explicit_schema=LINE, unexpected_field_behavior="ignore"))
        n = len(rows)
        rows = rows.add_column(0, "fiscal_year", pa.array([partition.fiscal_year] * n, pa.int32())).add_column(0, "ticker", pa.array([partition.ticker] * n, pa.string()))
        yield from rows.to_batches()


class LandedCalls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed_calls"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        folder = self.options["path"]
        return Reader(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach Python sources in it, without which Spark refuses a source that takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedCalls)
