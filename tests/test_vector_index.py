"""Vectors by cells: recall against brute force, exact mode, copies, odd rows; searches of many queries."""

import numpy as np

from tallyframe.operators import keyword_index as ki, vector_index as vi


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vector array<double>")


def test_cells(spark, tmp_path, monkeypatch):
    """Clusters, with a third of the rows copies of one vector, in parts of few rows."""
    monkeypatch.setattr(vi, "PART", 64)
    r = np.random.default_rng(3)
    x = np.concatenate([r.standard_normal((900, 8)) + 6 * r.integers(0, 12, (900, 1)), np.tile(r.standard_normal((1, 8)), (450, 1))])
    queries = x[::30]
    index = vi.build(frame(spark, x), f"file://{tmp_path}/v")
    assert 10 < len(index.centroids) <= 37 and index.rows().count() == len(x)
    want = {}
    for q, v in enumerate(queries):
        score = np.floor(-((x - v) ** 2).sum(1) * 1e6 + 0.5) / 1e6
        want[q] = [(int(i), float(score[i])) for i in np.lexsort((np.arange(len(x)), -score))[:10]]
    asked = frame(spark, queries, "qid")
    got = {}
    for row in vi.search(index, asked, 10, None).orderBy("qid", "place").collect():
        got.setdefault(row.qid, []).append((row.id, row.score))
    assert got == want
    probes = vi.probes_for(index, asked, 10)
    assert probes < len(index.centroids) and vi.recall(index, asked, 10, probes) >= 0.9 and vi.recall(index, asked, 10, len(index.centroids)) == 1


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    index = vi.build(none, f"file://{tmp_path}/v")
    assert index.rows().count() == 0 and vi.search(index, frame(spark, np.ones((2, 3)), "qid"), 3).count() == 0
    one = vi.build(frame(spark, np.ones((5, 3))), f"file://{tmp_path}/w")
    assert [r.id for r in vi.search(one, frame(spark, np.ones((1, 3)), "qid"), 3).orderBy("place").collect()] == [0, 1, 2]
    assert vi.search(one, none.withColumnRenamed("id", "qid"), 3).count() == 0


def test_search_many(spark, tmp_path):
    rows = [(1, "a b c", "x"), (2, "a a", "y"), (3, None, "x"), (4, "b d", "x"), (5, "", "y"), (6, "e f g h", "y"), (7, "e i", "x"), (8, "j k", "x")]
    index = ki.build(spark.createDataFrame(rows, "id long, content string, kind string"), f"file://{tmp_path}/k", ("kind",))
    vectors = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(1, 9)] + [(9, None)], "id long, vector array<double>")
    asked = [(1, "d nothing", [2.2, 0.0], "keyword"), (2, "d", [2.2, 0.0], "semantic"), (3, "d", [7.9, 0.0], "other"), (4, "zzz", None, "bm25"), (5, None, [1.0, 0.0], None), (6, "D d", None, "hybrid")]
    queries = spark.createDataFrame(asked, "qid long, query string, vector array<double>, method string")
    got = {}
    for r in ki.search_many(index, vectors, queries, 2).orderBy("qid", "place").collect():
        got.setdefault(r.qid, []).append(r.id)
    assert got == {1: [4], 2: [2, 3], 3: [8, 7], 5: [1, 2], 6: [4]}
    where = {r.id for r in ki.keyword_scores(index, spark.createDataFrame([(1, "a e")], "qid long, query string"), {"kind": ["y"]}).collect()}
    assert where <= {2, 6} and ki.keyword_scores(index, spark.createDataFrame([(1, "a")], "qid long, query string"), {"kind": ["none"]}).count() == 0


def test_pairs_of_query_and_row_stay_in_their_task(spark, tmp_path, monkeypatch):
    """All rows hold a word that all queries ask for: of each shard only k rows of a query leave it, and these are the k best of all pairs, ties by id."""
    monkeypatch.setattr(ki, "DOCS", 64)
    monkeypatch.setattr(ki, "QUERIES", 16)
    r = np.random.default_rng(5)
    rows = [(i, " ".join(["the", *(f"w{j}" for j in r.integers(0, 40, r.integers(0, 12)))]), "xyz"[i % 3]) for i in range(600)]
    chunks = spark.createDataFrame(rows, "id long, content string, kind string").repartition(2)
    queries = spark.createDataFrame([(q, f"the w{q % 40} w{q * 7 % 40} the") for q in range(50)], "qid long, query string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        index = ki.build(chunks, f"file://{tmp_path}/k", ("kind",))
        shards = index.table("postings").filter("word is null").count()
        assert shards >= 6
        for where in (None, {"kind": ["x", "z"]}):
            every = {}
            for row in ki.keyword_scores(index, queries, where).collect():
                every.setdefault(row.qid, []).append((-row.score, row.id))
            few = ki.keyword_scores(index, queries, where, 4)
            assert few.count() <= 4 * shards * 50 < sum(map(len, every.values()))
            got = {}
            for row in ki.top_of_each(few, 4).orderBy("qid", "place").collect():
                got.setdefault(row.qid, []).append((-row.score, row.id))
            assert got == {q: sorted(found)[:4] for q, found in every.items()}
            assert where is None or all(i % 3 != 1 for found in got.values() for _, i in found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_vectors_meet_queries_in_tasks(spark, monkeypatch):
    """However many blocks of queries and parts of vectors there are, it is one step of the plan, and its rows are those of brute force, ties by id."""
    monkeypatch.setattr(ki, "BLOCK", 16)
    monkeypatch.setattr(ki, "PART", 150, raising=False)
    monkeypatch.setattr(ki, "AT_ONCE", 1 << 11, raising=False)
    r = np.random.default_rng(7)
    x = np.concatenate([r.standard_normal((500, 6)), np.tile(r.standard_normal((1, 6)), (100, 1)), r.integers(0, 2, (300, 6)), np.full((1, 6), np.nan)]).astype(np.float32)
    v = np.concatenate([x[480:560:2], x[610:640]]).astype(np.float64)
    scores = ki.vector_scores(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)] + [(-1, None)], "id long, vector array<float>"), frame(spark, v, "qid"), 7)
    assert "Union" not in scores._jdf.queryExecution().optimizedPlan().toString()
    got = {}
    for row in ki.top_of_each(scores, 7).orderBy("qid", "place").collect():
        got.setdefault(row.qid, []).append((row.id, row.score))
    want = {}
    for q, vector in enumerate(v):
        score = np.floor(-((x[:-1].astype(np.float64) - vector) ** 2).sum(1) * 1e6 + 0.5) / 1e6
        want[q] = [(int(i), float(score[i])) for i in np.lexsort((np.arange(len(score)), -score))[:7]]
    assert got == want


def test_texts_are_read_once(spark, tmp_path, monkeypatch):
    """Words and rows by facet are added up from the shards, with nulls among facets; each row is read once."""
    monkeypatch.setattr(ki, "DOCS", 50)
    r = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{j}" for j in r.integers(0, 60, r.integers(0, 9))), [None, "x", "y"][i % 3], i % 4 if i % 7 else None) for i in range(400)]
    rows += [(400, None, "x", 1), (401, " \n\u00a0\u3000", "x", 1)]

    def seen(batches):
        for batch in batches:
            with open(f"{tmp_path}/seen", "a") as f:
                f.write("\n" * len(batch))
            yield batch

    kinds = "id long, content string, kind string, year int"
    chunks = spark.createDataFrame(rows, kinds).repartition(3).mapInArrow(seen, kinds)
    for facets in ((), ("kind", "year")):
        before = (tmp_path / "seen").stat().st_size if facets else 0
        index = ki.build(chunks, f"file://{tmp_path}/k{len(facets)}", facets)
        assert (tmp_path / "seen").stat().st_size - before == len(rows)
        df, of = {}, {}
        for _, content, *kind in rows:
            kind, words = tuple(kind[: len(facets)]), (content or "").split()
            if words:
                docs, length = of.get(kind, (0, 0))
                of[kind] = docs + 1, length + len(words)
            for w in set(words):
                df[w, *kind] = df.get((w, *kind), 0) + 1
        assert {tuple(x)[:-1]: x.df for x in index.table("words").select("word", *facets, "df").collect()} == df
        assert {tuple(x)[:-2]: tuple(x)[-2:] for x in index.table("rows").select(*facets, "docs", "length").collect()} == of
