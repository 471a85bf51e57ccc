"""Lexical search, exact top-k and whitening: brute force, odd rows, empty tables, clashing columns."""

import collections
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import lexical, registry, topk, whitening
from tallyframe.llm.common import whole_vectors

SCHEMA = "doc_id long, text string"


def clashing(df):
    """With columns whose names the operators use inside."""
    return df.select("*", *(F.lit(v).alias(n) for n, v in {"id": "x", "shard": 1, "term": "y", "rank": 0, "body": "z", "x": 2, "rid": 3, "asks": True, "part": 4, "score": 5}.items()))



# 11 ---------------------------------------------------------------------------------------------------------------
def by_hand(docs, items, k):
    """docs, items: (id, text). Rows (item, rank, doc, score)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, collections.Counter(split(t))) for i, t in docs if split(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(split(t))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in held:
            m = 100 - 25 + (25 * c.total() * n) // total
            s = sum(x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, x in terms.items() if c[t])
            if s > 0:
                found.append((-s, doc is None, doc or 0))
        out += [(item, r, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def texts(seed, n):
    r = random.Random(seed)
    odd = [(900, None), (901, ""), (902, " \n!?"), (903, "été Été ÉTÉ naïve漢字 é"), (904, "a" * 50_000), (905, "w1 " * 40_000), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "w5 w6"), (7, "w5 w6")]
    return odd + [(i, " ".join(r.choice(["w", "W", "x-"]) + str(int(r.paretovariate(0.7)) % 300) for _ in range(r.randrange(1, 60)))) for i in range(n)]


def test_lexical_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK", 1 << 10)
    items = [(1, "w1 w2 w2 W3"), (2, "x-9 w1 nothing"), (3, None), (4, "!!"), (5, "ÉTÉ naïve漢字"), (None, "w5"), (6, "w7"), (6, "w8 w7"), (8, "a" * 50_000)]
    docs = texts(1, 700)
    df = clashing(spark.createDataFrame(docs, SCHEMA).repartition(5))
    got = lexical.search(lexical.build(df), clashing(spark.createDataFrame(items, "item_id long, text string")), 20)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items, 20)


def test_lexical_shards_and_blocks(spark, monkeypatch):
    """Small shards and blocks, and the join that isn't a broadcast, give the same; ties by doc_id across shards."""
    for name, value in (("ITEMS", 3), ("ASKED", 0), ("PARTS", 4)):
        monkeypatch.setattr(lexical, name, value)
    docs, items = texts(2, 200), [(i, f"w{i} w1") for i in range(9)]
    index = lexical.build(spark.createDataFrame(docs, SCHEMA).repartition(3), most_docs=13)
    assert index.rows.filter("term is null").count() > 10
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, items, 4)


def test_lexical_index_whole(spark):
    """The index has every pair of document and term once, whatever is asked."""
    docs = texts(3, 100)
    index = lexical.build(spark.createDataFrame(docs, SCHEMA))
    pairs = index.rows.filter("term is not null").select("term", F.size("docs").alias("n"), F.size("impacts").alias("m"), "df").collect()
    want = collections.Counter(t for _, text in docs for t in {x.decode() for part in lexical.terms((text or "").encode()) for x in part})
    got = collections.Counter()
    for p in pairs:
        got[p.term] += p.n
    assert got == want and all(p.n == p.m == p.df for p in pairs)


def test_lexical_empty(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a b")], SCHEMA)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(none), items).collect() == []
    assert lexical.search(lexical.build(some), items.limit(0)).collect() == []
    assert [r.doc for r in lexical.search(lexical.build(some), items).collect()] == [1] or by_hand([(1, "a b")], [(1, "a")], 20) == []


# 12 ---------------------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>"


def vectors(seed, n, d=6, grid=False):
    r = random.Random(seed)
    one = (lambda: r.randrange(-2, 3) / 2) if grid else (lambda: r.gauss(0, 1))
    odd = [(800, None), (801, [1.0, None, 0.0]), (802, [float("nan")] * d), (900, [float("inf")] + [0.0] * (d - 1)), (803, []), (1000, [0.5, -0.25]), (None, [1.0] * d), (100, [1.0] * d), (100, [1.0] * d)]
    return odd + [(i, [one() for _ in range(d)]) for i in range(n)]


def whole(rows, scale):
    d = max((len(v) for _, v in rows if v is not None), default=0)
    return [(i, [math.floor(scale * float(np.float32(c))) for c in v] + [0] * (d - len(v))) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def pairs_by_hand(rows, every, k):
    rows = whole(rows, 1024)
    out = []
    for a, (q, x) in enumerate(rows):
        if q is not None and q % every == 0:
            found = sorted((-sum(s * t for s, t in zip(x, y, strict=True)), i is None, i or 0) for b, (i, y) in enumerate(rows) if a != b)[:k]
            out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(found, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("grid", [False, True])
def test_topk_by_brute_force(spark, monkeypatch, grid):
    """Grid: components of a few values, so most scores tie."""
    monkeypatch.setattr(topk, "ROWS", 60)
    monkeypatch.setattr(topk, "QUERIES", 9)
    rows = vectors(4, 400, grid=grid)
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = topk.nearest(whole_vectors(df, "vec_id", "embedding", 1024), F.col("id") % 20 == 0, 7)
    assert sorted(map(tuple, got.collect()), key=repr) == pairs_by_hand(rows, 20, 7)


def test_topk_bounds(monkeypatch):
    """The reading stops before the lists' end where it can, and whatever the depth the k best are among what is resolved, in each type of number."""
    r = np.random.default_rng(5)
    x = (r.standard_normal((3000, 5)) ** 3 * 1000).astype(np.int64)
    q = (r.standard_normal((20, 5)) ** 3 * 1000).astype(np.int64)
    exact = q @ x.T
    ended = 0
    for query, rows, scores in topk.top(x, q, 10):
        assert scores == exact[query, rows].tolist()
        assert set(np.flatnonzero(exact[query] >= np.sort(exact[query])[-10])) <= set(rows.tolist())
        ended += len(rows) > 10
    assert ended > 0  # more than the best: resolved from bounds, not from whole lists
    for scale, kind in ((1, np.float64), (1 << 24, np.int64), (1 << 40, object)):
        assert topk.kind(x[:200] * scale, q) is kind
        got = {j: sorted(s, reverse=True)[:3] for j, _, s in topk.top(x[:200] * scale, q, 3)}
        assert got == {j: sorted((scale * int(s) for s in exact[j, :200]), reverse=True)[:3] for j in range(len(q))}


def test_topk_few_and_none(spark):
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, None)], [(0, [1.0]), (1, [2.0]), (100, [-1.0])], [(1, [1.0])], [(0, []), (1, [])]):
        got = topk.nearest(whole_vectors(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", 1024), F.col("id") % 100 == 0, 10)
        assert sorted(map(tuple, got.collect()), key=repr) == pairs_by_hand(rows, 100, 10)
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.nearest(whole_vectors(huge, "vec_id", "embedding", 1024), F.col("id") == 0, 10).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63)}


# 13 ---------------------------------------------------------------------------------------------------------------
def check_whitening(rows, got, k=4):
    rows = whole(rows, 256)
    fit = sorted({tuple(x) for _, x in rows})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[float(sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)]
    values, vecs = np.linalg.eigh(np.array(cov))
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == len(rows) * min(k, d) and {g.n for g in got} == {n}
    want = collections.defaultdict(list)
    for i, x in rows:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        w = [float(sum((c - Fraction(s, n)) * Fraction(float(v)) for c, s, v in zip(x, sums, vecs[:, j], strict=True))) / math.sqrt(values[j]) for j in range(min(k, d))]
        want[i].append((dev, w))
    have = collections.defaultdict(list)
    for g in got:
        have[g.vec_id, g.component].append(g)
    for j in range(min(k, d)):
        signs = set()
        for i, found in want.items():
            pairs = zip(sorted(have[i, j + 1], key=lambda g: (g.deviation, abs(g.whitened))), sorted(found, key=lambda f: (f[0], abs(f[1][j]))), strict=True)
            for g, (dev, w) in pairs:
                assert g.deviation == dev and abs(abs(g.whitened) - abs(w[j])) < 1e-9
                if abs(w[j]) > 1e-6:
                    signs.add(g.whitened * w[j] > 0)
                assert abs(g.explained - values[j] / np.trace(np.array(cov))) < 1e-12
        assert len(signs) == 1
    assert len({g.identity_error for g in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening_by_fractions(spark):
    rows = [(i, [c * (j + 1) for j, c in enumerate(v or [])] if v and None not in v else v) for i, v in vectors(6, 150)]
    df = clashing(spark.createDataFrame(rows, VECTORS).repartition(4))
    check_whitening(rows, whitening.whiten(whole_vectors(df, "vec_id", "embedding", 256)).collect())


def test_whitening_far_from_zero(spark):
    """Mean 10**9 times the spread: a covariance in plain doubles loses it."""
    r = random.Random(7)
    rows = [(i, [4e6 + r.randrange(4) / 256 * (j + 1) for j in range(3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    plain = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    found = whitening.fit(df.select(F.transform("embedding", lambda c: F.floor(256 * c)).alias("x")).distinct(), 3)
    fit = sorted({tuple(x) for _, x in plain})
    n = len(fit)
    for i in range(3):
        for j in range(3):
            exact = sum((x[i] - Fraction(found.sums[i], n)) * (x[j] - Fraction(found.sums[j], n)) for x in fit) / n
            assert abs(Fraction(found.covariance[i, j]) - exact) <= abs(exact) * Fraction(1, 2**51) + Fraction(1, 2**60)


def test_double_doubles():
    r = np.random.default_rng(8)
    high = r.standard_normal((257, 4)) * 10.0 ** r.integers(-8, 8, (257, 4))
    low = high * 2.0**-54 * r.standard_normal((257, 4))
    own = whitening.Outer(4)
    own.take(high, low)
    for at, (i, j) in enumerate(zip(own.i, own.j, strict=True)):
        exact = sum((Fraction(a) + Fraction(b)) * (Fraction(c) + Fraction(e)) for a, b, c, e in zip(high[:, i].tolist(), low[:, i].tolist(), high[:, j].tolist(), low[:, j].tolist(), strict=True))
        size = sum(abs(Fraction(a) * Fraction(c)) for a, c in zip(high[:, i].tolist(), high[:, j].tolist(), strict=True))
        assert abs(Fraction(own.high[at]) + Fraction(own.low[at]) - exact) < size * Fraction(1, 2**95)


def test_whitening_odd(spark):
    run = lambda rows, kind="float": sorted(whitening.whiten(whole_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"), "vec_id", "embedding", 256)).collect(), key=repr)
    assert run([]) == [] and run([(1, None), (2, [None])]) == [] and run([(1, [])]) == []
    same = run([(1, [1.0, 2.0])] * 3 + [(None, [1.0, 2.0])])
    assert len(same) == 8 and {(g.n, g.deviation, g.whitened, g.explained) for g in same} == {(1, 0, None, None)}
    line = run([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0])])
    assert [g.whitened is None for g in sorted(line, key=lambda g: (g.vec_id, g.component))] == [False, True, False, False, True, True] and line[0].identity_error < 1e-12
    assert {g.deviation for g in run([(1, [1e300]), (2, [-1e300])], "double")} == {2**63 - 1}


def test_whitening_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(rows, registry.queries()["op13_whitening"](spark, sf_dir).collect())
