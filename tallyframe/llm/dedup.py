"""Exact duplicates through static binary-fuse filters.

A batch of documents is held against an immutable snapshot, a set of tables written once: the digests of its different texts, and for each bucket
of digests one binary-fuse filter (9 bits a digest). Any number of batches can be screened by it (`snapshot_of`, `open_snapshot`, `screened`). Digests of the batch are first grouped among
themselves, map-side, so that a group of copies of any size is one row; the groups pass through the filter of their bucket, a large batch in parts of a bucket;
what passes joins the snapshot's exact digests, and the two representatives are compared byte for byte. No group is ever gathered in one task: all that
moves by digest are partial counts, and the join that hands each document its group may be split by AQE.

Defined results: null text counts as empty; rows that repeat a doc_id and its text are members of one group, of which one
row stays; a null doc_id is smaller than any other; an empty table gives an empty result; other columns are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: The snapshot has one filter for so many digests; and this many buckets at least.
KEYS_A_BUCKET, LEAST_BUCKETS = 1 << 16, 256


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A static set of 64-bit keys: no false negatives, about one false positive in 256."""

    def __init__(self, seed: int, length: int, starts: int, cells: np.ndarray):
        self.seed, self.length, self.starts, self.cells = seed, length, starts, cells

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Length of a segment (a power of 2) and the number of segments in which a key's first cell may lie."""
        length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
        return length, max(1, -(-int(n * factor) // length) - 2)

    def _cells_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = _mix(keys, self.seed)
        mask = np.uint64(self.length - 1)
        first = ((h >> np.uint64(32)) * np.uint64(self.starts * self.length)) >> np.uint64(32)
        at = np.stack([first, (first + np.uint64(self.length)) ^ ((h >> np.uint64(18)) & mask), (first + np.uint64(2 * self.length)) ^ (h & mask)])
        return at.astype(np.int64), (h ^ (h >> np.uint64(32))).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """Peels in rounds: all cells with a single key give that key up at once; cells are filled in reverse."""
        keys = np.unique(keys.astype(np.uint64))
        length, starts = cls.shape(len(keys))
        for seed in range(1, 200):
            self = cls(seed, length, starts, np.zeros((starts + 2) * length, np.uint8))
            at, prints = self._cells_of(keys)
            count = np.bincount(at.ravel(), minlength=len(self.cells))
            held = np.zeros(len(self.cells), np.int64)
            order = np.arange(len(keys))
            for row in at:
                np.bitwise_xor.at(held, row, order)
            rounds, left = [], len(keys)
            while left:
                single = np.flatnonzero(count == 1)
                if not len(single):
                    break
                peeled, which = np.unique(held[single], return_index=True)
                rounds.append((peeled, single[which]))
                for row in at[:, peeled]:
                    np.subtract.at(count, row, 1)
                    np.bitwise_xor.at(held, row, peeled)
                left -= len(peeled)
            if left:
                starts += seed % 8 == 0  # a little more room if many seeds fail
                continue
            for peeled, cell in reversed(rounds):
                three = self.cells[at[:, peeled]]
                self.cells[cell] = prints[peeled] ^ three[0] ^ three[1] ^ three[2]
            return self
        raise RuntimeError("no seed peels these keys")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        at, prints = self._cells_of(keys.astype(np.uint64))
        three = self.cells[at]
        return (three[0] ^ three[1] ^ three[2]) == prints

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.length, self.starts], np.int64).tobytes() + self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> BinaryFuse:
        seed, length, starts = np.frombuffer(data, np.int64, 3)
        return cls(int(seed), int(length), int(starts), np.frombuffer(data, np.uint8, offset=24))


def _keys(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The first 8 bytes of each digest."""
    return np.frombuffer(b"".join(x[:8] for x in column.to_pylist()), "<u8")


def _build(rows: pa.Table) -> pa.Table:
    return pa.table({"bucket": rows["bucket"][:1].cast(pa.int64()), "filter": pa.array([BinaryFuse.build(_keys(rows["digest"])).to_bytes()], pa.binary())})


def _screen(batch: pa.Table, filters: pa.Table) -> pa.Table:
    hit = BinaryFuse.from_bytes(filters["filter"][0].as_py()).contains(_keys(batch["digest"])) if len(filters) and len(batch) else np.zeros(len(batch), bool)
    return pa.table({"digest": batch["digest"].filter(pa.array(hit)).cast(pa.binary())})


def _digested(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with digest (SHA-256 of the text in UTF-8), n_bytes and second (another hash), which must agree as well."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("second"))


KEY = ["digest", "n_bytes", "second"]


@dataclass
class Snapshot:
    """groups: KEY, top (id and rid of the row that stays), size, one row for each different text. filters: bucket and its filter. Both are stored; neither ever changes."""

    groups: DataFrame
    filters: DataFrame
    buckets: int


def snapshot_of(groups: DataFrame) -> Snapshot:
    """The snapshot of groups of equal texts (a stored table): its filters are built and written once."""
    buckets = max(LEAST_BUCKETS, -(-groups.count() // KEYS_A_BUCKET))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")
    return Snapshot(groups, stored(groups.select(bucket, "digest").groupBy("bucket").applyInArrow(_build, "bucket long, filter binary"), "filters"), buckets)


def save_snapshot(snapshot: Snapshot, path: str) -> None:
    """Writes a snapshot to a folder, for open_snapshot()."""
    snapshot.groups.write.parquet(f"{path}/groups")
    snapshot.filters.withColumn("buckets", F.lit(snapshot.buckets)).write.parquet(f"{path}/filters")


def open_snapshot(spark: SparkSession, path: str) -> Snapshot:
    filters = spark.read.parquet(f"{path}/filters")
    first = filters.select("buckets").first()
    return Snapshot(spark.read.parquet(f"{path}/groups"), filters.drop("buckets"), first[0] if first else LEAST_BUCKETS)


def screened(new: DataFrame, snapshot: Snapshot) -> DataFrame:
    """digest: those of new (digest, ..., a row each) that the snapshot's filters let pass: all that the snapshot has, and one other in 256. A group is a part of a bucket, of about KEYS_A_BUCKET digests at most."""
    parts = max(1, -(-new.count() // (snapshot.buckets * KEYS_A_BUCKET)))
    bucket, part = F.pmod(F.xxhash64("digest"), F.lit(snapshot.buckets)), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(parts))
    filters = snapshot.filters.select(F.col("bucket").alias("of"), "filter", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("of_part"))
    return new.select(bucket.alias("bucket"), part.alias("part"), "digest").groupBy("bucket", "part").cogroup(filters.groupBy("of", "of_part")).applyInArrow(_screen, "digest binary")


def find_copies(docs: DataFrame, in_snapshot: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, groups) of equal texts in the snapshot and the batch together.

    in_snapshot: which rows are the snapshot (default: half, by a hash of the id); the others are the batch.
    documents: id, rid (a number of the row), digest, n_bytes, second, snap. groups: digest, n_bytes, second, top (id and rid of the row that stays: the largest id), size; one row for each different text."""
    chosen = F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0 if in_snapshot is None else in_snapshot
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("own_text"), F.coalesce(chosen, F.lit(False)).alias("snap"))
    documents = stored(_digested(own, "own_text").drop("own_text").withColumn("rid", F.monotonically_increasing_id()), "digests")
    both = stored(documents.groupBy(*KEY, "snap").agg(F.max(F.struct("id", "rid")).alias("top"), F.count(F.lit(1)).alias("size")), "copygroups")
    old, new = both.filter("snap").drop("snap"), both.filter("not snap").drop("snap")
    hits = screened(new, snapshot_of(old))
    exact = old.select(*KEY, F.col("top").alias("old_top"), F.col("size").alias("old_size"))
    positives = stored(new.join(hits, "digest", "left_semi").join(exact, KEY), "positives")
    merged = positives.join(_equal_bytes(own, positives), "digest", "left_semi").select(*KEY, F.greatest("top", "old_top").alias("top"), (F.col("size") + F.col("old_size")).alias("size"))
    return documents, merged.unionByName(both.drop("snap").join(merged.select("digest"), "digest", "left_anti"))


def _equal_bytes(own: DataFrame, positives: DataFrame) -> DataFrame:
    """Digests of positives whose two representatives have the same bytes."""
    ends = positives.select("digest", F.col("second").alias("end_second"), F.explode(F.array("top.id", "old_top.id")).alias("end_id")).distinct()
    texts = own.select("id", F.coalesce("own_text", F.lit("")).alias("own_text")).withColumn("second", F.xxhash64("own_text"))
    # by id and hash, so rows that share an id don't all meet; the same join at every size: a side that is small now is not small later
    texts = texts.join(ends.hint("merge"), F.col("id").eqNullSafe(F.col("end_id")) & (F.col("second") == F.col("end_second"))).filter(F.unhex(F.sha2("own_text", 256)) == F.col("digest"))
    return texts.groupBy("digest").agg((F.min("own_text") == F.max("own_text")).alias("equal")).filter("equal").select("digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without copies: of equal texts the row with the largest id stays, of rows that repeat it one. Columns stay as they are."""
    documents, groups = find_copies(docs, id_col=id_col, text_col=text_col)
    copied = stored(groups.filter("size > 1").select(*KEY, F.col("top.id").alias("keep")), "kept")
    tied = documents.join(copied, KEY).filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy(*KEY).count().filter("count > 1").select(*KEY)
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    own = docs.toDF(*names.values())
    marked = _digested(own.withColumn("own_id", F.col(names[id_col]).cast("long")), names[text_col]).join(copied.withColumn("many", F.lit(True)), KEY, "left")
    kept = marked.filter("many is null or own_id <=> keep")
    if not tied.isEmpty():
        tied = stored(tied, "tied")
        kept = kept.join(tied, KEY, "left_anti").unionByName(kept.join(tied, KEY, "left_semi").dropDuplicates([*KEY, "own_id"]))
    return kept.select(*(F.col(v).alias(c) for c, v in names.items()))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """One row for each document: which of its equals stays, how many they are, and whether it is the one."""
    documents, groups = find_copies(table(spark, sf_dir, "documents"))
    return documents.drop("snap").join(groups, KEY).select(
        F.col("id").alias("doc_id"), F.col("top.id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        F.struct("id", "rid").eqNullSafe(F.col("top")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
