"""Fiscal calendars, stored LTM rows, tables by partition, the data source of calls, structure of calls."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

from tallyframe.functions import fiscal
from tallyframe.operators import calendars as ca, fundamentals as fu, relational as rel, structure as sr
from tallyframe.sources import landed_calls as lc
from tallyframe.sources.partitioned import Partitioned
from tallyframe.sources.scratch import clear, drop, written

D = dt.date.fromisoformat


def test_calendar_of_every_year_end(spark):
    """All twelve year ends over 40 years: each day is in one quarter, the one that the rules say."""
    companies = spark.createDataFrame([(m, m, D("1990-02-15"), D("2029-11-03")) for m in range(1, 13)], "c int, m int, a date, b date")
    days = ca.calendar(companies, "c", "m", "a", "b").collect()
    for m in range(1, 13):
        own = sorted((r.start, r.end, r.fiscal_year, r.quarter) for r in days if r.c == m)
        assert own[0][0] <= D("1990-02-15") <= own[0][1] and own[-1][0] <= D("2029-11-03") <= own[-1][1] and len(own) in (160, 161)
        for (_, e, y, q), (s, _, y2, q2) in zip(own, own[1:], strict=False):
            assert s == e + dt.timedelta(1) and (y2 * 4 + q2) == (y * 4 + q) + 1
        assert all(e.month == m and e.year == y for _, e, y, q in own if q == 4)
    rows = companies.select("c", "m", F.explode(F.expr("sequence(a, b, interval 17 days)")).alias("day"))
    met = ca.with_quarter(rows, ca.calendar(companies, "c", "m", "a", "b"), "c", "day")
    wrong = met.filter((F.col("fiscal_year") != fiscal.year_by_month(F.col("day"), F.col("m"))) | (F.col("quarter") != fiscal.quarter_of(F.col("day"), F.col("m"))))
    assert met.count() == rows.count() and wrong.isEmpty()


def test_quarters_between(spark):
    df = spark.createDataFrame([(9, D("2000-08-01"), D("2023-10-05")), (12, D("2024-01-01"), D("2023-01-01"))], "m int, a date, b date")
    every = [(r.year, r.quarter) for r in fiscal.quarters_between(df, "a", "b", end_month=F.col("m")).collect()]
    assert every[0] == (2024, 1) and every[-1] == (2000, 4) and len(every) == 94
    few = [(r.year, r.quarter) for r in fiscal.quarters_between(df, "a", "b", 2011, 50, F.col("m")).collect()]
    assert few == every[:50]


def test_latest_info(spark):
    rows = [(1, "Assets", "USD", D("2023-09-30"), 2023, "FY"), (1, "Assets", "USD", D("2023-12-31"), 2024, "Q1"), (1, "Assets", "EUR", D("2025-12-31"), 2025, "Q1"), (1, "Cash", "USD", D("2026-12-31"), 2025, "Q1"), (2, "Assets", "USD", None, 2024, "Q1"), (3, "Assets", "USD", D("2024-05-31"), 2024, "Q3")]
    facts = spark.createDataFrame(rows, "cik int, tag string, unit string, end date, fy int, fp string")
    got = ca.latest_info(facts).withColumn("m", ca.end_month(F.col("end"), F.col("fp"))).collect()
    assert sorted((r.cik, r.fy, r.fp, r.m) for r in got) == [(1, 2024, "Q1", 9), (3, 2024, "Q3", 8)]


def test_reports_of_a_period(spark):
    rows = [("A", "10-K", "2023", "FY", D("2023-12-31")), ("A", "10-Q", "2024", "1", D("2024-03-31")), ("A", "10-Q", "2023", "3", D("2023-09-30")), ("B", "10-K", "2023", None, D("2023-12-31")), ("C", "10-Q", "2023", "2", D("2023-06-30")), ("D", "10-K", "2023", "FY", D("2023-12-31")), ("D", "10-Q", "2023", "4", D("2023-12-31"))]
    reports = spark.createDataFrame(rows, "ticker string, form_type string, fiscal_year string, fiscal_quarter string, period_end_date date")
    got = lambda p: sorted((r.ticker, r.form_type, r.fiscal_quarter) for r in ca.in_period(reports, reports, p, ["ticker"]).collect())
    assert got("latest") == [("A", "10-Q", "1"), ("B", "10-K", None), ("C", "10-Q", "2"), ("D", "10-K", "FY")]
    assert got("latest_10k") == [("A", "10-K", "FY"), ("B", "10-K", None), ("D", "10-K", "FY")]
    assert got("latest_10q") == [("A", "10-Q", "1"), ("C", "10-Q", "2"), ("D", "10-Q", "4")]
    assert len(got("latest_10k_and_10q")) == 6 and len(got("all")) == 7


@pytest.mark.parametrize(("old", "new", "hours", "taken"), [
    ("quarterly_sum", "fy_direct", 1, True), ("fy_direct", "standard_fy_only", 1, True), ("standard_fy_only", "enhanced_quarterly_sum", 1, True), ("enhanced_quarterly_sum", "standard_full", 1, True),
    ("unknown", "quarterly_sum", 1, True), ("standard_full", "enhanced_quarterly_sum", 99, False), ("fy_direct", "fy_direct", 24, False), ("fy_direct", "fy_direct", 25, True), ("fy_direct", "fy_direct", None, False), ("odd", "unknown", 25, True), ("odd", "quarterly_sum", 0, True),
])
def test_replacing(spark, old, new, hours, taken):
    at = dt.datetime(2024, 6, 1, 12)
    kind = "cik int, period_end_date date, calculation_method string, ltm_calculation_date timestamp, v int"
    was = spark.createDataFrame([(1, D("2024-03-31"), old, at - dt.timedelta(hours=hours) if hours is not None else None, 1), (2, D("2024-03-31"), old, at, 5)], kind)
    now = spark.createDataFrame([(1, D("2024-03-31"), new, None, 2), (1, D("2024-03-31"), "unknown", None, 3), (3, D("2024-03-31"), new, None, 4)], kind)
    got = {r.cik: (r.v, r.calculation_method) for r in fu.replaced(was, now, "2024-06-01 12:00:00").collect()}
    assert got == {1: (2, new) if taken else (1, old), 2: (5, old), 3: (4, new)}


def test_reset_companies(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))], "cik int, updated_at timestamp")
    assert {r.cik: r.updated_at is None for r in rel.reset_companies(rows, rows.filter("cik = 2")).collect()} == {1: False, 2: True}


def test_a_merge_rewrites_its_partitions_only(spark, tmp_path):
    kind = "ticker string, v int, date string"
    table = Partitioned(spark, f"file://{tmp_path}/t", kind, ["ticker", "date"], "date")
    frame = lambda *rows: spark.createDataFrame(list(rows), kind)
    assert table.read().count() == 0
    table.upsert(frame(*((t, 1, f"2024-01-{d:02}") for t in "AB" for d in range(1, 9))))
    files = lambda: {os.path.relpath(os.path.join(d, f), tmp_path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")}
    before = files()
    for _ in range(2):  # a merge that is run again gives the same
        table.upsert(frame(("A", 2, "2024-01-03"), ("C", 2, "2024-01-09")))
        got = {(r.ticker, r.date): r.v for r in table.read().collect()}
        assert got == {(t, f"2024-01-{d:02}"): 1 for t in "AB" for d in range(1, 9)} | {("A", "2024-01-03"): 2, ("C", "2024-01-09"): 2}
    after = files()
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "date=2024-01-03" in f}
    table.insert_absent(frame(("A", 7, "2024-01-03"), ("D", 7, "2024-01-03")))
    table.upsert_known(frame(("A", None, "2024-01-01")))
    got = {(r.ticker, r.date): r.v for r in table.read().collect()}
    assert got["A", "2024-01-03"] == 2 and got["D", "2024-01-03"] == 7 and got["A", "2024-01-01"] == 1
    with pytest.raises(ValueError):
        table.upsert(frame(("A", 1, None)))


def test_scratch_tables_go(spark):
    a, b = (written(spark.range(3)) for _ in range(2))
    drop(a)
    assert b.count() == 3
    with pytest.raises(Exception, match="."):
        a.count()
    clear(spark)
    with pytest.raises(Exception, match="."):
        b.count()


def test_source_of_calls(spark, tmp_path):
    for t, y, n in (("A", 2020, 2), ("A", 2021, 3), ("B C", 2021, 1)):
        folder = tmp_path / f"ticker={t.replace(' ', '%20')}" / f"fiscal_year={y}"
        folder.mkdir(parents=True)
        (folder / "x.json").write_text("".join(json.dumps({"quarter": k, "seq": 0, "speaker": "S", "content": f"{t}{y}é", "more": 1}) + "\n" for k in range(1, n + 1)))
        (folder / "empty.json").write_text("")
    reader = lambda: lc.Reader(f"file://{tmp_path}")
    assert len(reader().partitions()) == 3
    filters = [EqualTo(("ticker",), "A"), GreaterThan(("fiscal_year",), 2020), StringContains(("content",), "x"), EqualTo(("quarter",), 2)]
    r = reader()
    assert list(r.pushFilters(filters)) == filters[2:] and [(p.ticker, p.fiscal_year) for p in r.partitions()] == [("A", 2021)]
    r = reader()
    assert list(r.pushFilters([In(("ticker",), ("B C", "Z"))])) == [] and [p.ticker for p in r.partitions()] == ["B C"]
    lc.register(spark)
    rows = spark.read.format("landed_calls").load(str(tmp_path))
    assert sorted((x.ticker, x.fiscal_year, x.quarter, x.content) for x in rows.collect()) == [("A", 2020, 1, "A2020é"), ("A", 2020, 2, "A2020é"), ("A", 2021, 1, "A2021é"), ("A", 2021, 2, "A2021é"), ("A", 2021, 3, "A2021é"), ("B C", 2021, 1, "B C2021é")]
    assert rows.filter("fiscal_year = 2021 and ticker = 'A' and quarter > 1").count() == 2


def test_structure_of_a_call(spark):
    text = "Welcome to the call.\n\nJane Doe (Chief Executive): Good day.\n  We grew. \nOperator: First question.\nTom Fox (Analyst, Bank): How much: a lot?\nJane Doe: Yes.\nQ: And next year?\nStill next year?\nA: More.\nMore: of it\n"
    raw = spark.createDataFrame([(1, text), (2, None), (3, " \n "), (4, "no speaker\nat all")], "call int, raw string")
    got = [tuple(r) for r in sr.turns(raw, "call", "raw").orderBy("call", "seq").collect()]
    o, q = sr.REMARKS, sr.QUESTIONS
    assert got == [
        (1, 1, o, "UNKNOWN", None, "statement", "Welcome to the call."), (1, 2, o, "Jane Doe", "Chief Executive", "statement", "Good day. We grew."), (1, 3, o, "Operator", None, "statement", "First question."),
        (1, 4, q, "Tom Fox", "Analyst, Bank", "statement", "How much: a lot?"), (1, 5, q, "Jane Doe", None, "statement", "Yes."), (1, 6, q, "Q", None, "qa", "And next year?"), (1, 7, q, "UNKNOWN", None, "statement", "Still next year?"),
        (1, 8, q, "A", None, "qa", "More."), (1, 9, q, "More", None, "statement", "of it"), (4, 1, o, "UNKNOWN", None, "statement", "no speaker"), (4, 2, o, "UNKNOWN", None, "statement", "at all"),
    ]
    own = {(r.call, r.section): r for r in sr.sections(sr.turns(raw, "call", "raw"), "call").collect()}
    assert own[1, o].titles == {"UNKNOWN": "", "Jane Doe": "Chief Executive", "Operator": ""} and own[1, o].turns == 3
    assert own[1, q].text.startswith("Tom Fox: How much: a lot?\nJane Doe: Yes.\nQ: And next year?")
    rec = {r.call: r for r in sr.records(sr.turns(raw, "call", "raw"), "call").collect()}
    assert rec[1].participants == ["UNKNOWN", "Jane Doe", "Operator", "Tom Fox", "Q", "A", "More"] and rec[1].turns == 9
    assert rec[1].text.startswith(f"OPENING REMARKS\n{'-' * 15}\nUNKNOWN: Welcome") and "\n\nQ&A SESSION\n-----------\nTom Fox" in rec[1].text
    assert set(rec) == {1, 4}
