"""Tables that cut a plan: written to the folder that all executors share, read back, and deleted when nothing reads them any more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that written() made and nothing has deleted.
_made: set[str] = set()
#: The folder of a local session that has none.
_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder's path, in that of checkpoints; a local session may have none, and gets one temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tallyframe-"))
        root = _own[0]
    return f"{root.rstrip('/')}/tallyframe/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, where a plan reads it several times: it is computed once, and what reads it has a short plan."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    _made.add(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(*frames: DataFrame) -> None:
    """Deletes the tables of written() that these read; nothing may read them afterwards."""
    for df in frames:
        for path in {p for p in _made if any(p in f for f in df.inputFiles())}:
            _made.discard(path)
            delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Deletes all tables of written() that are left: for a session between reports, when it no longer reads what it got before."""
    while _made:
        delete(spark, _made.pop())
