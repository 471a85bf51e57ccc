"""Tables with versions, exports, streams with late data, readers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyframe.sources import readers, tables
from tallyframe.streaming import prices as st


def test_table(spark, tmp_path):
    t = tables.Table(spark, str(tmp_path / "t"), "k int, v string", ["k"])
    assert t.read().count() == 0
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v string")
    t.upsert(make((1, "a"), (2, "b")))
    t.upsert(make((2, "c"), (3, "d")))
    t.upsert_known(make((3, None), (4, "e")))
    t.insert_absent(make((4, "x"), (5, "f")))
    t.delete(F.col("k") == 1)
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "c"), (3, "d"), (4, "e"), (5, "f")]
    assert t.info()["rows"] == 4 and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v")]) == 2


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_export(spark, tmp_path, kind):
    df = spark.range(5).withColumn("m", F.array(F.lit(1)))
    tables.export(df, str(tmp_path / kind), kind)
    assert (spark.read.option("header", True).csv if kind == "csv" else getattr(spark.read, kind))(str(tmp_path / kind)).count() == 5
    with pytest.raises(ValueError):
        tables.export(df, str(tmp_path / "x"), "xls")


def test_index(spark, tmp_path):
    df = spark.createDataFrame([("1", "A", {"k": 1}), ("2", "B", {"k": 2})], "id string, ticker string, metadata map<string, int>")
    for overwrite in (False, False, True):
        tables.index_chunks(df, str(tmp_path / "i"), overwrite)
    got = spark.read.parquet(str(tmp_path / "i"))
    assert got.count() == 2 and json.loads(got.filter("ticker = 'A'").first()["metadata"]) == {"k": 1}


def test_fresh(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 2)), (2, dt.datetime(2024, 1, 1))], "k int, updated_at timestamp")
    assert [r.k for r in tables.fresh(df, 24, "2024-01-02 12:00:00").collect()] == [1]


def events(spark, folder, rows):
    spark.createDataFrame(rows, st.EVENTS).coalesce(1).write.mode("append").parquet(folder)


def test_stream_takes_late_events(spark, tmp_path):
    at = lambda h, d=1: dt.datetime(2024, 1, d, h)
    folder, table = str(tmp_path / "in"), tables.Table(spark, str(tmp_path / "bars"), st.BAR, ["ticker", "date"])
    run = lambda: st.keep_bars(st.stream(spark, folder, "*.parquet"), table, str(tmp_path / "cp")).awaitTermination()
    events(spark, folder, [(2, at(10), 1, "a", 5.0, "{}"), (3, at(11), 1, "a", 7.0, "{}")])
    run()
    events(spark, folder, [(1, at(9), 1, "a", 4.0, "{}"), (9, at(1, 2), 1, "a", 1.0, "{}")])
    run()
    run()
    rows = {str(r.date): (r.open_price, r.high_price, r.low_price, r.close_price, r.volume) for r in table.read().collect()}
    assert rows == {"2024-01-01": (4.0, 7.0, 4.0, 7.0, 3), "2024-01-02": (1.0, 1.0, 1.0, 1.0, 1)}


def test_windows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    folder = str(tmp_path / "in")
    events(spark, folder, [(1, at(1), 1, "a", 5.0, ""), (1, at(1), 1, "a", 5.0, ""), (2, at(1, 30), 1, "a", 9.0, ""), (3, at(9), 1, "a", 1.0, "")])
    st.run_to_end(st.windows(st.stream(spark, folder, "*.parquet")), str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.start, r.n, r.high, r.low) for r in rows] == [(at(1), 2, 9.0, 5.0)]


def test_readers(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps({"cik": 320193, "entityName": "A", "facts": {"us-gaap": {"Assets": {"units": {"USD": [{"end": "2024-09-28", "filed": "2024-11-01", "fy": 2024, "fp": "FY", "form": "10-K", "val": 5}]}}}}}))
    row = readers.company_facts(spark, str(tmp_path / "f.json")).first()
    assert (row.cik, row.tag, row.unit, row.val, str(row.end)) == ("0000320193", "Assets", "USD", 5.0, "2024-09-28")
    (tmp_path / "0000320193-24-000123.txt").write_text("CONFORMED SUBMISSION TYPE:\t10-K\nCONFORMED PERIOD OF REPORT:\t20241031\nFISCAL YEAR END:\t0930\n<TEXT>body</TEXT>")
    files = readers.filing_files(spark, str(tmp_path)).filter("path like '%.txt'")
    assert str(files.first().filing_date) == "2024-01-01" and readers.recent_filings(files, 1, "2026-06-01").count() == 0
    head = readers.filing_headers(readers.filings(spark, str(tmp_path / "0000320193-24-000123.txt"))).first()
    assert (head.form_type, head.fiscal_year, head.company_name) == ("10-K", 2025, None)
    with pytest.raises(KeyError):
        readers.TRANSCRIPT_SOURCES.read(spark, "x", "unknown")


def test_ciks(spark):
    df = spark.createDataFrame([("12",), ("0000320193",), ("x",), (None,)], "c string")
    assert [r[0] for r in df.select(readers.padded_cik(F.col("c"))).collect()] == ["0000000012", "0000320193", None, None]
