"""Sizes and shapes at which operators used to lose rows or time."""

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import dedup, jaccard, licenses, linkgraph


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(4000)}" for _ in range(n)]


@pytest.mark.parametrize("n", [200, 1036, 1400, 6000])
def test_long_templates_are_found(spark, n):
    body = " ".join(["license", *words(1, n)])
    cues = tuple(sorted(set(body.split())))[::200] + ("license",)
    rows = [(1, body), (2, " ".join(words(2, 3000)) + " " + body + " " + " ".join(words(3, 3000))), (3, " ".join(words(4, n)))]
    found = {(x.doc_id, x.license) for x in licenses.matches(spark.createDataFrame(rows, "doc_id long, text string"), templates=(("long-1", body), ("mit", "Released under the MIT License")), cues=cues).collect()}
    assert found == {(1, "long-1"), (2, "long-1")}
    widths = {r.width for r in licenses.catalogue(spark, (("long-1", body),)).collect()}
    assert widths == {licenses.width_of(licenses.n_shingles(body))}


def test_links_among_blanks(spark):
    """A megabyte of blanks, words or half links is read in time in proportion; and the two patterns mean the same."""
    duckdb = pytest.importorskip("duckdb")
    r = random.Random(3)
    bits = ["href", "src", "=", " ", "\n", "'", '"', "http:", "//", "a.com", "B.org/x", "ftp+x:", "x", ":", "<", ">", "?"]
    rows = [(i, "http://own.net/", "".join(r.choice(bits) for _ in range(40)) + "href = ' http://z.com/'") for i in range(300)]
    con = duckdb.connect()
    both = spark.createDataFrame(rows, "page_id long, url string, html string").select("html", F.regexp_extract_all("html", F.lit(linkgraph.LINK), F.lit(1)).alias("x")).collect()
    assert all(con.execute("select regexp_extract_all(?, ?, 1)", [b.html, linkgraph.PLAIN]).fetchone()[0] == b.x for b in both)
    long = [(1, "http://a.com/", "//href=" + " " * 1_000_000), (2, "http://a.com/", "//href=" + "a" * 1_000_000), (3, "http://a.com/", "//" + "href= " * 200_000), (4, "http://a.com/", "//src" + "\t" * 1_000_000 + "='//b.com'")]
    began = time.time()
    assert [tuple(x) for x in linkgraph.host_links(spark.createDataFrame(long, "page_id long, url string, html string")).collect()] == [("a.com", "b.com", 1)]
    assert time.time() - began < 15


def near_copies(n, ids):
    base = words(5, 120)
    return [(ids(i), " ".join([*base[: i % 100], f"x{i}", *base[i % 100 :]])) for i in range(n)]


def test_rows_without_ids_dont_all_meet(spark):
    """1,200 near copies without an id: one component, and each text is fetched once."""
    rows = near_copies(1200, lambda i: None)
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found.texts.count() == found.kinds.count() == 1200
    out = jaccard.connected(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()
    own = jaccard.connected(spark.createDataFrame(near_copies(1200, lambda i: i), "doc_id long, text string"), counts=True).collect()
    assert collections.Counter(r.n_links for r in out) == collections.Counter(r.n_links for r in own) and {r.component_id for r in out} == {None}


def test_copies_among_rows_of_one_id(spark):
    rows = [(7, f"text {i % 50}") for i in range(400)] + [(None, f"text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents, groups = dedup.find_copies(docs, F.col("doc_id").isNull())
    assert {(g.size, g.top.id) for g in groups.withColumnRenamed("size", "n").selectExpr("n as size", "top").collect()} == {(9, 7), (1, None)}
    assert documents.count() == 500


def test_batch_far_larger_than_snapshot(spark, monkeypatch):
    """A bucket of a large batch goes in parts."""
    monkeypatch.setattr(dedup, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(dedup, "KEYS_A_BUCKET", 100)
    rows = [(i, f"t{i % 3000}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents, groups = dedup.find_copies(docs, F.col("doc_id") < 5)
    got = {r.id: r.keep for r in documents.join(groups, dedup.KEY).select("id", F.col("top.id").alias("keep")).collect()}
    assert got == {i: i % 3000 + 3000 for i in range(6000)}


def test_snapshot_is_kept_with_its_filters(spark, tmp_path):
    """A saved snapshot screens several batches: no digest of it is ever missed, few others pass."""
    texts = lambda low, high: spark.createDataFrame([(f"t{i}",) for i in range(low, high)], "text string")
    digests = lambda low, high: dedup._digested(texts(low, high), "text").select(*dedup.KEY, F.struct(F.lit(1).cast("long").alias("id"), F.lit(2).cast("long").alias("rid")).alias("top"), F.lit(1).cast("long").alias("size"))
    dedup.save_snapshot(dedup.snapshot_of(digests(0, 5000)), f"file://{tmp_path}/s")
    kept = dedup.open_snapshot(spark, f"file://{tmp_path}/s")
    for low, high, least in ((0, 5000, 5000), (2500, 7500, 2500), (6000, 9000, 0)):
        passed = dedup.screened(digests(low, high), kept)
        n = passed.count()
        assert passed.join(kept.groups, "digest", "left_semi").count() == least and n - least < 80
    assert dedup.screened(digests(0, 0), kept).count() == 0


def test_pairs_leave_one_tile(spark, monkeypatch):
    """Near copies of one text, most of them below the threshold to the first: a pair goes on once, not from each key that it shares, and rounds of nearest ones give no more pairs than classes."""
    r, base = random.Random(8), words(6, 150)
    copy = lambda: [w if r.random() > 0.025 else f"y{r.randrange(10**6)}" for w in base]
    rows = [(i, " ".join(copy())) for i in range(300)]
    made, by_tile = [], jaccard._by_tile

    def spied(*args, **kwargs):
        out = by_tile(*args, **kwargs).cache()
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "_by_tile", spied)
    monkeypatch.setattr(jaccard, "TILE", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.connected(docs).collect()}
    assert len(made) > 1 and all(n == different for n, different in made) and all(n <= len(rows) for n, _ in made[:-1])
    exact = {x.doc_id: x.component_id for x in jaccard.connected(docs, exact=True).collect()}
    assert got == exact


def test_tiles_are_dealt_from_short_rows(spark, monkeypatch):
    """Bitmaps, keys and texts join rows that have their tile, once a class, and of keys only those that others have too: what moves by key grows with the number of rows that meet, not with all that they hold."""
    r, base = random.Random(9), words(7, 150)
    copy = lambda: [w if r.random() > 0.03 else f"y{r.randrange(10**6)}" for w in base]
    rows = [(i, " ".join(copy() if i % 3 else words(1000 + i, 150))) for i in range(150)]
    seen, kept, by_tile, stored = [], [], jaccard._by_tile, jaccard.stored

    def spied(members, more, *args, **kwargs):
        seen.append(({t for _, t in members.dtypes}, more.count(), more.select("node").distinct().count(), members.count(), sum(len(x.keys) for x in more.select("keys").collect()) if "keys" in more.columns else None))
        return by_tile(members, more, *args, **kwargs)

    def kept_as(df, label, rows=None):
        kept.append((label, {t for _, t in df.dtypes}))
        return stored(df, label, rows)

    monkeypatch.setattr(jaccard, "_by_tile", spied)
    monkeypatch.setattr(jaccard, "stored", kept_as)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in jaccard.connected(docs, counts=True).collect()}
    assert got[1] == min(i for i in range(150) if got[i] == got[1]) and all(got[i] == i for i in range(0, 150, 3))
    assert len(seen) > 1 and all(types <= {"bigint", "int"} and n == nodes for types, n, nodes, _, _ in seen)
    assert all(keys is None or keys == rows for _, _, _, rows, keys in seen)
    assert all(types <= {"bigint", "int"} for label, types in kept if label in ("met", "mixed", "members"))
