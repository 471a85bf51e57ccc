"""Queries of this subpackage against their SQL."""

import random
from pathlib import Path

import pytest

from tallyframe.llm import linkgraph, registry

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"create view {t} as select * from '{path / '*.parquet' if path.is_dir() else path}'")
    df = registry.queries()[name](spark, sf_dir)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    order = sorted(df.columns)
    assert sorted(columns) == order
    assert sorted(([r[c] for c in order] for r in df.collect()), key=repr) == sorted(([r[columns.index(c)] for c in order] for r in found.fetchall()), key=repr)


def test_verdicts_over_links(spark):
    """The test pages have no links between hosts; these do."""
    r = random.Random(4)
    hosts = [f"h{i}.{t}" for i in range(8) for t in ("com", "net", "org", "example.com")]
    rows = [(i, r.choice(["http://", "https://", ""]) + r.choice(hosts) + r.choice(["/en/", "/es/x", "/fr/", "", "/de/?q"]), "".join(f'<a href="http://{r.choice(hosts)}/x">' for _ in range(r.randrange(4)))) for i in range(200)] + [(900, None, None)]
    con = duckdb.connect()
    con.execute("create table pages(page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = {x[0]: x[1:] for x in con.execute(linkgraph.OP10_SQL).fetchall()}
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in linkgraph.verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and len({v[3] for v in want.values() if v[2] is None}) == 2
