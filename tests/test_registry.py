"""Every query runs on the smallest tables; those with SQL are held against it."""

import datetime
import decimal
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from tallyframe.plans import registry, views  # noqa: E402

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for name in views.TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{path / '*.parquet' if path.is_dir() else path}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal | float):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, oracle, name):
    df = registry.queries()[name](spark, sf_dir)
    order = sorted(df.columns)
    rows = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    if name not in SQL:
        return
    found = oracle.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == order
    assert rows == sorted(([plain(r[columns.index(c)]) for c in order] for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
