"""Exact top-k by inner product, through sorted lists read in sequence and no random access.

Candidates are dealt out in shards of about ROWS. Within a shard each component has a sorted list of the candidates. A query reads
the lists of its positive weights from the upper end and those of its negative weights from the lower end, all to the same depth. What was
read gives each candidate a lower bound (components not read yet count as the least that the list holds) and an upper bound (they
count as what the list has at the present depth). A query reads on until all but a few candidates have upper bounds
below its k-th lower bound: those outsiders can't qualify, and the scores of the few are resolved. Nothing is left out: with lists that bound badly
the reading goes to their end, where both bounds are the score.

Scale: a group is one shard and one block of queries, both bounded, and each pair of them is met once; the bounds of a block are products of small
matrices. Only k rows for each query leave a group, and two steps of windows merge them. Hot ids don't matter: rows are dealt by their number.
The one table between is in the shared folder, so a lost executor costs its running tasks.

Defined results: vectors that are null or hold a null or non-finite component take no part; a shorter vector counts as filled up with zeros;
rows that repeat a vec_id are rows of their own (each a query, if the id is one; none meets itself, all meet each other); a null vec_id is no query and comes last among equal
scores; products beyond longs are exact inside and end at the longs' limits; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_matrix, best, stored, table, whole_vectors

#: Candidates of a shard and queries of a block, as expected; the reading of lists stops to look at bounds at these shares of their length.
ROWS, QUERIES, DEPTHS = 4096, 1024, (1 / 16, 1 / 8, 1 / 4, 1 / 2, 1)
#: So many times k candidates at most are resolved before the lists end.
FEW = 8
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def kind(x: np.ndarray, q: np.ndarray) -> type:
    """The fastest type in which sums of products of the two are exact."""
    reach = max(map(abs, (int(x.min()), int(x.max())))) * max(map(abs, (int(q.min()), int(q.max())))) * x.shape[1] * 4
    return np.float64 if reach < 1 << 53 else np.int64 if reach < 1 << 62 else object


def top(x: np.ndarray, q: np.ndarray, k: int):
    """For each row of q: numbers of the rows of x that can be among its k best, and their exact scores (ints). At least k if x has so many; all that tie with the k-th are there."""
    n, exact = len(x), kind(x, q)
    x, q = x.astype(exact), q.astype(exact)
    up, down = np.where(q > 0, q, 0), np.where(q < 0, -q, 0)
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, 0)
    least, most = lists[0], lists[-1]
    high, low = np.zeros_like(x), np.zeros_like(x)  # what was read, less the least (the most) of its list
    new_up, new_down = np.ones(x.shape, bool), np.ones(x.shape, bool)  # not read yet
    active, floor, read = np.arange(len(q)), up @ least - down @ most, 0
    lower = np.zeros((n, len(q)), exact)
    for share in DEPTHS:
        depth = n if share == 1 else int(n * share)
        if depth <= read:
            continue
        for side, edge, start, stop, unread in ((high, least, n - depth, n - read, new_up), (low, most, read, depth, new_down)):
            side[:] = 0
            np.put_along_axis(side, order[start:stop], lists[start:stop] - edge, 0)
            np.put_along_axis(unread, order[start:stop], False, 0)
        lower += high @ up[active].T - low @ down[active].T
        read = depth
        if read == n:
            break
        at_up, at_down = lists[n - depth], lists[depth - 1]
        slack = new_up.astype(exact) @ (up[active] * (at_up - least)).T + new_down.astype(exact) @ (down[active] * (most - at_down)).T
        bar = np.partition(lower, n - k, 0)[n - k] if n >= k else lower.min(0) - 1
        may = lower + slack >= bar
        done = may.sum(0) <= FEW * k
        for j in np.flatnonzero(done):
            rows = np.flatnonzero(may[:, j])
            yield active[j], rows, [int(v) for v in x[rows] @ q[active[j]]]
        active, lower = active[~done], lower[:, ~done]
        if not len(active):
            return
    for j, query in enumerate(active):
        s = lower[:, j] + floor[query]
        rows = np.flatnonzero(s >= np.partition(s, n - k)[n - k]) if n > k else np.arange(n)
        yield query, rows, [int(v) for v in s[rows]]


def _nearest(k: int, width: int):
    def run(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(held) and len(asked):
            ids, rids, query_rids, query_ids = held["id"].to_pylist(), held["rid"].to_pylist(), asked["query_rid"].to_pylist(), asked["query_id"].to_pylist()
            for query, rows, scores in top(as_matrix(held["x"], width), as_matrix(asked["query"], width), k + 1):  # one more, for the query's own row
                own = query_rids[query]
                found = sorted((-s, ids[i] is None, ids[i] or 0) for i, s in zip(rows.tolist(), scores, strict=True) if rids[i] != own)[:k]
                out += [(own, query_ids[query], None if none else i, max(LEAST, min(MOST, -s))) for s, none, i in found]
        columns = list(zip(*out, strict=True)) or [()] * 4
        shard = [key[0].as_py()] * len(out)
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("rid", "query_id", "vec_id", "score"), columns, strict=True)} | {"shard": pa.array(shard, pa.int64())})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: of vectors (id, x: array of longs) the k others of highest inner product with each row that is a query, by score, then id."""
    rows = stored(vectors.select("id", "x", F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("rid", F.monotonically_increasing_id()), "vectors")
    n, asks, width = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("x"))).first()
    width = width or 1
    shards, blocks = max(1, -(-n // ROWS)), max(1, -(-asks // QUERIES))

    def dealt(of: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(of))

    def each(of: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(of - 1).cast("long")))

    held = rows.select("rid", "id", "x", dealt(shards, 1).alias("shard")).withColumn("block", each(blocks))
    asked = rows.filter("asks").select(F.col("rid").alias("query_rid"), F.col("id").alias("query_id"), F.col("x").alias("query"), dealt(blocks, 2).alias("block")).withColumn("shard", each(shards))
    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_nearest(k, width), "rid long, query_id long, vec_id long, score long, shard long")
    return best(found, ["rid"], [F.desc("score"), F.asc_nulls_last("vec_id")], k, F.col("shard")).select("query_id", "rank", "vec_id", "score")


def op12_topk(spark, sf_dir: str) -> DataFrame:
    """For every hundredth vector its 10 best among the others."""
    return nearest(whole_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1024), F.col("id") % 100 == 0, 10)


OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda t: t[1] * t[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p) WHERE rank <= 10
"""
