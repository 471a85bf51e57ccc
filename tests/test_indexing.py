"""Stored indexes: files to chunks, calls to chunks; repeated, half-done and failing runs."""

from pyspark.sql import functions as F

from tallyframe.functions import text as tx
from tallyframe.operators import indexing as ix
from tallyframe.sources import readers
from tallyframe.sources.batches import Batches

HEAD = "CONFORMED SUBMISSION TYPE:\t{}\nCONFORMED PERIOD OF REPORT:\t{}\nFISCAL YEAR END:\t0930\n"


def filing(form, period, body):
    return HEAD.format(form, period) + f"<TEXT>{body}</TEXT>"


BODY = "\n\n".join(f"Paragraph {k} says that revenue was {k}0 million. " + "It grew by a lot in all regions. " * 12 for k in range(30))


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_filings_from_files(spark, tmp_path):
    land, path = tmp_path / "landed", f"file://{tmp_path}/index"
    land.mkdir()

    def put(name, text):
        (land / name).write_text(text)

    put("abc-1.txt", filing("10-K", "20230930", BODY))
    put("abc-2.txt", filing("10-Q", "20231230", BODY.replace("revenue", "income")))
    put("abc-3.txt", filing("8-K", "20231230", BODY))
    put("abc-4.txt", "no header at all")
    put("abc-5.txt", filing("10-Q", "yesterday", BODY))
    put("abc-6.txt", " \n")
    index = ix.filing_index(spark, path)
    texts = lambda: readers.filings(spark, f"file://{land}")
    assert ix.index_filings(texts(), index, "one")
    name = F.element_at(F.split("path", "/"), -1)
    first = rows(index.read("files"), name, "status", "reason", "fiscal_year", "fiscal_quarter")
    assert first == [
        ("abc-1.txt", "indexed", None, "2023", "FY"), ("abc-2.txt", "indexed", None, "2024", "1"), ("abc-3.txt", "failed", "other form", "2024", "1"),
        ("abc-4.txt", "failed", "no form", None, None), ("abc-5.txt", "failed", "no period", None, None), ("abc-6.txt", "failed", "empty", None, None),
    ]
    chunks = index.read("chunks")
    macro = {r.text for r in chunks.filter("granularity = 'macro'").collect()}
    assert macro == {c for b in (BODY, BODY.replace("revenue", "income")) for c in tx.paragraph_chunks(b)}
    made = {c for m in macro for c in tx.micro_chunks(m, 300, 60)}
    assert {r.text for r in chunks.collect()} == macro | made
    assert chunks.count() == chunks.select("text_hash").distinct().count() == chunks.select("row_id").distinct().count()
    assert index.read("files").agg(F.sum("n_chunks")).first()[0] == chunks.count()
    n = chunks.count()
    # again, under its own name and under another: nothing new
    assert not ix.index_filings(texts(), index, "one")
    assert ix.index_filings(texts(), index, "two") and index.read("files").count() == 6 and index.read("chunks").count() == n
    # a failed file that has changed, a filing that is known under another name, and a new one
    put("abc-4.txt", filing("10-Q", "20240330", BODY.replace("revenue", "profit")))
    put("abc-7.txt", filing("10-K", "20230930", "another text of the same filing"))
    ix.index_filings(texts(), index, "three")
    assert rows(index.read("files").filter("batch = 'three'"), name, "status") == [("abc-4.txt", "indexed"), ("abc-7.txt", "duplicate")]
    assert {r[0] for r in rows(index.read("chunks").filter("batch = 'three'"), name)} == {"abc-4.txt"}
    assert rows(ix.coverage(index, F.col("batch")).filter("batch = 'one'"), "status", "reason", "files")[0] == ("failed", "empty", 1)


def test_half_a_run_is_repeated(spark, tmp_path, monkeypatch):
    texts = spark.createDataFrame([(f"/x/abc-{k}.txt", filing("10-Q", f"2023{3 * k:02}28", f"{BODY} {k}")) for k in range(1, 5)], "path string, text string")
    index = ix.filing_index(spark, f"file://{tmp_path}/index")
    ix.index_filings(texts.filter("path like '%1.txt'"), index, "a")
    before = rows(index.read("chunks"), "row_id")
    real = spark.createDataFrame

    def broken(data, schema=None, **more):
        if schema == "batch string":
            raise RuntimeError("the driver is gone")
        return real(data, schema, **more)

    monkeypatch.setattr(spark, "createDataFrame", broken)
    try:
        ix.index_filings(texts, index, "b")
    except RuntimeError:
        pass
    monkeypatch.undo()
    assert index.committed() == ["a"] and rows(index.read("chunks"), "row_id") == before and index.read("files").count() == 1
    ix.index_filings(texts, index, "b")
    assert index.read("files").count() == 4 and index.read("chunks").count() == index.read("chunks").select("row_id").distinct().count()


def test_calls_by_rounds(spark, tmp_path):
    said = [(t, 2023, q, s, "Ann" if s % 2 else "Bob", f"{t} {q} {s} " + "word " * (30 * s)) for t in "AB" for q in (1, 2, 3) for s in range(4)]
    turns = spark.createDataFrame(said, "ticker string, fiscal_year int, quarter int, seq int, speaker string, content string")
    expected = spark.createDataFrame([(t, 2023, q) for t in "AB" for q in (1, 2, 4)], "ticker string, fiscal_year int, quarter int")
    index = ix.call_index(spark, f"file://{tmp_path}/index")
    assert ix.index_calls(turns.filter("quarter = 1"), expected, index, "r1", words=20)
    assert rows(index.read("quarters"), "ticker", "quarter", "turns") == [("A", 1, 4), ("B", 1, 4)]
    assert rows(index.read("missing"), "ticker", "quarter") == [(t, q) for t in "AB" for q in (2, 4)]
    assert rows(ix.quarters_to_fetch(expected, index), "ticker", "quarter") == [(t, q) for t in "AB" for q in (2, 4)]
    ix.index_calls(turns, expected, index, "r2", words=20)
    assert rows(index.read("quarters"), "ticker", "quarter", "batch") == [(t, q, f"r{q}") for t in "AB" for q in (1, 2)]  # quarter 3 isn't expected
    chunks = index.read("chunks").collect()
    for t, _, q, s, who, text in said:
        own = sorted((c.piece, c.text, c.speaker) for c in chunks if (c.ticker, c.quarter, c.seq) == (t, q, s))
        assert own == ([] if q == 3 else [(k, " ".join(text.split()[20 * k : 20 * k + 20]), who) for k in range(-(-len(text.split()) // 20))])
    assert not ix.index_calls(turns, expected, index, "r2") and ix.index_calls(turns, expected, index, "r3")
    assert index.read("chunks").count() == len(chunks)


def test_batches_take_all_tables(spark, tmp_path):
    store = Batches(spark, f"file://{tmp_path}/b", {"x": "a int", "y": "b int"})
    one = spark.createDataFrame([(1,)], "a int")
    try:
        store.commit("k", x=one)
        raise AssertionError
    except ValueError:
        pass
    assert store.committed() == [] and store.read("x").count() == 0
    assert store.commit("k", x=one, y=one.toDF("b")) and not store.commit("k", x=one, y=one.toDF("b"))
    assert rows(store.read("x"), "a", "batch") == [(1, "k")]


def test_chunks_leave_a_worker_in_bounded_batches():
    """One batch of texts gives many batches of chunks, none much over GIVEN characters or over MOST rows; order, ids and empty texts stay."""
    import pyarrow as pa

    from tallyframe.operators import chunks as ch

    texts = ["x" * (1 << 18)] * 20 + [None, ""] + ["a b " * 5000] * 3
    make = lambda t: [t[: len(t) // 2], t[len(t) // 2 :]] if t and t[0] == "x" else (t or "").split()
    batch = pa.RecordBatch.from_pydict({"id": pa.array([{"a": i} for i in range(len(texts))]), "text": pa.array(texts, pa.string())})
    out = list(ch.cutter(make)(iter([batch])))
    assert len(out) > 4 and all(sum(map(len, b.column(2).to_pylist())) < ch.GIVEN + (1 << 18) and len(b) <= ch.MOST for b in out)
    got = [(i["a"], k, c) for b in out for i, k, c in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)]
    assert got == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(make(t))]


def test_filing_chunks_cut_texts_once(spark):
    """One Python stage makes the chunks of both grains; copies go before sections and densities are computed; rows are those of the two chunkers, one after the other."""
    from tallyframe.operators import chunks as ch

    texts = [(f"p{i}", "abc", "10-K", "2023", "FY", t) for i, t in enumerate([BODY, BODY, BODY.replace("revenue", "income"), "short", "", None])]
    good = spark.createDataFrame(texts, "path string, ticker string, form_type string, fiscal_year string, fiscal_quarter string, body string")
    made = ix.filing_chunks(good)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    macro = ch.paragraph_chunks(good, "path", "body")
    micro = ch.micro_chunks(macro.select(F.struct("id", "seq").alias("of"), "text"), "of", "text").select("id.id", "id.seq", F.col("seq").alias("part"), "text")
    every = macro.select("id", "seq", F.lit(0).alias("part"), "text", F.lit("macro").alias("g")).unionByName(micro.withColumn("g", F.lit("micro")))
    want = ch.one_of_each_hash(every.select("*", F.md5("text").alias("text_hash"), F.concat_ws("_", "id", "g", "seq", "part").alias("row_id")), "row_id")
    assert rows(made, "row_id", "seq", "part", "granularity", "text", "text_hash") == rows(want, "row_id", "seq", "part", "g", "text", "text_hash") != []


def test_blank_documents_of_a_filing(spark, tmp_path):
    """The header of a submission without a text is no chunk; the queries agree with their SQL where texts are null, empty or blank."""
    import duckdb

    from tallyframe.plans import indexes

    texts = {"/x/abc-1.txt": "", "/x/abc-2.txt": " \n", "/x/abc-3.txt": BODY}
    index = ix.filing_index(spark, f"file://{tmp_path}/index")
    ix.index_filings(spark.createDataFrame([(p, filing("10-Q", f"2023{3 * k:02}28", t)) for k, (p, t) in enumerate(texts.items(), 1)], "path string, text string"), index, "a")
    assert rows(index.read("files"), "path", "status", F.col("n_chunks") > 0) == [("/x/abc-1.txt", "indexed", False), ("/x/abc-2.txt", "indexed", False), ("/x/abc-3.txt", "indexed", True)]
    assert {r.path for r in index.read("chunks").select("path").distinct().collect()} == {"/x/abc-3.txt"}
    odd = [(i, [None, "", " \n ", "short", f"Text {i}. {BODY}"][i % 5], "en" if i % 3 else "fr", f"src{i % 2}", 4000 if i % 2 else 10) for i in range(120)]
    spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/sf/documents.parquet/*.parquet'")
    for name in ("index_filings", "indexed_chunks"):
        query, sql = indexes.QUERIES[name]
        got, found = query(spark, f"{tmp_path}/sf"), con.execute(sql)
        assert rows(got, *(c[0] for c in found.description)) == sorted(found.fetchall(), key=repr)
