"""Ranked lexical search over document-sharded postings.

A shard is a set of documents, at most DOCS of them and about POSTINGS pairs of document and term. Its postings are a
matrix in compressed rows: a row for each term, in the order of terms, with the documents that hold it (numbers within the shard, in the order
of doc_id) and the whole-number impact of each, computed when the index is built; one more row holds the shard's doc_ids. The index is
a table, so a search reads what it needs of it by a join on terms.

A search goes term at a time: for each item, the impacts of each of its terms, times the term's weight, are added to a dense array over
the shard's documents; argpartition finds the k-th score, and what ties with it is taken in the order of doc_id. A group is
one shard and one block of items, bounded on both sides. The shards' best rows are merged in two steps of windows.

Scale: the texts are read twice (for the two sums that impacts need, and for the postings) and nothing of their size is shuffled. A frequent term is
a row for each shard. The terms asked for are broadcast up to ASKED of them (counted), beyond that the join on terms is dealt out by shard too.
A lost executor costs its running tasks; the index is in the shared folder.

Defined results: null text has no terms, and documents without terms are not in the index; texts of any length are read whole; rows that
share an item_id (null too) are one item with the terms of all; rows that repeat a doc_id are documents of their own, and a null doc_id comes last
among equal scores; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import best, mapped, stored, table

#: A shard ends at so many documents or postings; items of a block; terms asked for up to which they are broadcast, and parts of a term beyond.
DOCS, POSTINGS, ITEMS, ASKED, PARTS = 1 << 15, 1 << 21, 1024, 200_000, 64
#: Bytes of a text that are cut into terms at once, and rows of a batch that a shard gives out.
CHUNK, BATCH_ROWS = 1 << 20, 1 << 14
#: Bytes as terms have them: A-Z as a-z; those of no term as a space. All bytes of characters beyond ASCII belong to terms, so bytes do for characters.
TERM_BYTES = bytes(b | 0x20 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

INDEX = "shard long, term string, df long, docs array<int>, impacts array<int>, ids array<long>"


def terms(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about CHUNK bytes."""
    text = (text or b"").translate(TERM_BYTES)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + CHUNK)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            n = sum(map(len, terms(text)))
            docs, total = docs + (n > 0), total + n
    yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([total])], ["docs", "total"])


class _Numbers(dict):
    """Numbers its keys as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = found = len(self)
        return found


class Shard:
    """Postings of some documents, gathered document by document."""

    def __init__(self, most_docs: int, most_postings: int) -> None:
        self.most_docs, self.most_postings = most_docs, most_postings
        self.numbers, self.ids, self.sizes = _Numbers(), [], []
        self.held, self.term, self.tf = array("i"), array("i"), array("q")

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        counts: Counter[bytes] = Counter()
        for part in terms(text):
            counts.update(part)
        if counts:
            self.ids.append(doc_id)
            self.sizes.append(counts.total())
            self.held.append(len(counts))
            self.term.extend(map(self.numbers.__getitem__, counts))
            self.tf.extend(counts.values())

    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or len(self.term) >= self.most_postings

    def rows(self, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """Rows of INDEX. A document of n terms has m = 75 + 25 * n * N div L, and a term with tf occurrences in it the impact 10**9 * tf div (1000 * tf + 12 * m)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i]))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        held = np.frombuffer(self.held, np.int32)
        m = np.array([75 + 25 * n * n_docs // n_terms for n in self.sizes], np.int64)
        tf = np.frombuffer(self.tf, np.int64)
        impact = (10**9 * tf // (1000 * tf + 12 * np.repeat(m, held))).astype(np.int32)
        names = list(self.numbers)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        key = rank[np.frombuffer(self.term, np.int32)] << 32 | np.repeat(place, held)
        at = np.argsort(key)
        docs, impact = (key[at] & 0xFFFFFFFF).astype(np.int32), impact[at]
        ends = np.concatenate([[0], np.cumsum(np.bincount(key >> 32, minlength=len(names)))]).astype(np.int32)
        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("docs", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pydict({"shard": [shard], "term": [None], "df": [len(order)], "docs": [None], "impacts": [None], "ids": [[self.ids[i] for i in order]]}, schema)
        for a in range(0, len(names), BATCH_ROWS):
            b = min(a + BATCH_ROWS, len(names))
            cut, off = slice(ends[a], ends[b]), pa.array(ends[a : b + 1] - ends[a])
            lists = [pa.ListArray.from_arrays(off, pa.array(v[cut])) for v in (docs, impact)]
            columns = [pa.array(np.full(b - a, shard)), pa.array([names[i].decode() for i in by_name[a:b]]), pa.array(np.diff(ends[a : b + 1]).astype(np.int64)), *lists, pa.nulls(b - a, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


@dataclass
class Index:
    """A stored index: rows of INDEX, the number of documents with a term, and the number of all their terms."""

    rows: DataFrame
    docs: int
    terms: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_docs: int = DOCS, most_postings: int = POSTINGS) -> Index:
    """The index of all documents, written to the shared folder. A shard ends when it has most_docs documents or most_postings postings."""
    text = F.col(text_col).cast("binary").alias("body")
    sums = mapped(docs.select(text), _counted, "docs long, total long").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).first()
    n_docs, n_terms = sums["docs"] or 0, sums["total"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = Shard(most_docs, most_postings), TaskContext.get().partitionId() << 32
        for batch in batches:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, body.as_py())
                if shard.full():
                    yield from shard.rows(number, n_docs, n_terms)
                    shard, number = Shard(most_docs, most_postings), number + 1
        if shard.ids:
            yield from shard.rows(number, n_docs, n_terms)

    return Index(stored(mapped(docs.select(F.col(id_col).cast("long").alias("id"), text), run, INDEX), "postings"), n_docs, n_terms)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item, term, times = [], [], []
        for one, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts: Counter[bytes] = Counter()
            for part in terms(text.as_py()):
                counts.update(part)
            item += [one] * len(counts)
            term += [t.decode() for t in counts]
            times += counts.values()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(term, pa.string()), pa.array(times, pa.int64())], ["item", "term", "times"])


def _join(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """rows of the index with what is wanted of their terms; n rows are wanted."""
    if n <= ASKED:
        return rows.join(F.broadcast(wanted), "term")
    dealt = wanted.withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.withColumn("dealt", F.pmod(F.xxhash64("shard"), F.lit(PARTS)).cast("int")).join(dealt, ["term", "dealt"]).drop("dealt")


def _scorer(k: int):
    def run(rows: pa.Table, held: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if len(rows) and len(held):
            ids = held["ids"].combine_chunks()
            ids = ids.flatten().to_pylist()
            docs, impacts = ([np.asarray(x.values) for x in rows[c]] for c in ("docs", "impacts"))
            wants: dict[int | None, list[tuple[int, int]]] = {}
            for row, items in enumerate(rows["items"].to_pylist()):
                for x in items:
                    wants.setdefault(x["item"], []).append((row, x["weight"]))
            for item, own in wants.items():
                score = np.zeros(len(ids), np.int64)
                for row, weight in own:  # a document is once in a term's row
                    score[docs[row]] += weight * impacts[row].astype(np.int64)
                hit = np.flatnonzero(score)
                if len(hit) > k:
                    s = score[hit]
                    least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
                    over = hit[s > least]
                    hit = np.concatenate([over, hit[s == least][: k - len(over)]])  # numbers are in the order of ids
                found += [(item, ids[i], int(score[i])) for i in hit.tolist()]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item", "doc", "score"), columns, strict=True)} | {"shard": pa.array([rows["shard"][0].as_py()] * len(found) if found else [], pa.int64())})

    return run


def search(index: Index, items: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, rank, doc, score: the k documents of each item with the highest scores above 0, equal ones by doc_id."""
    asked = mapped(items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("binary").alias("body")), _asked, "item long, term string, times long")
    asked = stored(asked.groupBy("item", "term").agg(F.sum("times").alias("times")), "asked")
    n_asked, n_items = asked.count(), asked.select("item").distinct().count()
    blocks = max(1, -(-n_items // ITEMS))
    rows = index.rows.filter("term is not null")
    holds = _join(rows.select("shard", "term", "df"), asked.select("term").distinct(), n_asked).groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.ln((2 * F.lit(index.docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long") * F.col("times")
    weighed = asked.join(holds, "term").select("term", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), F.struct("item", weight.alias("weight")).alias("one")).filter("one.weight > 0")
    wanted = stored(weighed.groupBy("term", "block").agg(F.collect_list("one").alias("items")), "wanted")  # at most about ITEMS in a list: a block's
    hits = _join(rows.select("shard", "term", "docs", "impacts"), wanted, wanted.count()).select("shard", "block", "docs", "impacts", "items")
    held = index.rows.filter("term is null").select(F.col("shard").alias("in_shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("for_block"), "ids")
    found = hits.groupBy("shard", "block").cogroup(held.groupBy("in_shard", "for_block")).applyInArrow(_scorer(k), "item long, doc long, score long, shard long")
    return best(found, ["item"], [F.desc("score"), F.asc_nulls_last("doc")], k, F.xxhash64("shard")).select("item", "rank", "doc", "score")


def op11_lexical(spark, sf_dir: str) -> DataFrame:
    """For each benchmark item its 20 documents."""
    found = search(build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


OP11_SQL = r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counts GROUP BY ALL),
whole AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sizes),
lengths AS (SELECT doc_id, 100 - 25 + (25 * n * nn) // ll AS m FROM sizes, whole),
weights AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counts, whole GROUP BY term, nn),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
items AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scores AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM items JOIN weights USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
