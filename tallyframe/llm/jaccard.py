"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact intersection of sorted arrays.

A document's set are the 64-bit hashes of its five-word shingles. Equal sets are one class. Classes that may be linked
meet under band keys: of SLOTS minima of the set, ROWS at a time, under a class of sizes (small sets take many permutations
with few bins, large ones few permutations with many); two sets at the threshold share no key with a probability of
(1 - 0.75 ** ROWS) ** BANDS = 3e-10, more alike ones with far less. Candidates are verified in rounds:

1. each class against one other under the same keys (that with most keys in common, of the smallest of each key): this
   joins most groups of copies with as many comparisons as they have members;
2. and 3. what shares a key but no component yet: tiles of classes of one size band or two next to each
   other, in which bitmap signatures bound the difference from below (7 * xor bits <= |x| + |y| must hold); first only
   the nearest of each class goes on (of one tile of each key), again while at least half of these are linked, then everything that the bound
   leaves. Either way a pair goes on from the first key that it has in common, not from each of them.

A key's classes are one tile, sorted by size and compared within the bounds of size only, if there are TILE of them and HELD shingles at most; else they are dealt
by size band and, as far as a band has more than that, by hash. So a tile is bounded in rows and in bytes, whatever the group and the texts.

Links are counted afterwards, tile by tile within each component (link_counts()).

Band keys may lose a link, with the probability above; with exact=True classes meet under the prefixes of their sorted sets instead, which
lose none: of two linked sets, each has one of the other's shingles among its first n - ceil(0.75 * n) + 1. A shingle that very many texts share is then one
key for a quarter of them, so that is for when certainty is worth the comparisons (still in bounded tiles).

Each candidate is verified on the sets of the whole texts, computed anew. Groups of any size are split into tiles, and no pair of copies within a class is looked at, nor, for components, one of classes already connected. A hot key or class is a
skewed join, which AQE splits, or a partial minimum. Tables between rounds are written to the shared folder.

Defined results: null text counts as empty; an empty set is linked with nothing; texts are read whole; repeated rows are
members of one class; a null doc_id is no one's component_id unless all are null; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, kept_by, mapped, stored, table
from .components import components

SHINGLE, ROWS, BANDS, BITS = 5, 3, 40, 2048
#: Classes of a tile, and shingles of all of them together (a tile pair has twice that; a single class may have more).
TILE, HELD = 512, 1 << 19
SLOTS = ROWS * BANDS
#: Largest set of each class of sizes, and the bins of a permutation there; a class has SLOTS / bins permutations.
SIZES = ((16, 1), (64, 4), (256, 15), (1024, 60), (1 << 62, 120))
#: Pairs of a tile whose keys are compared at once.
PAIRS = 1 << 14
#: Words that a worker keeps hashed, and bytes of text that it works on at once.
KEEP, WORK = 100_000, 1 << 19

_random = np.random.default_rng(5)
_FACTORS = _random.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMS = _random.integers(1, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(1, 1 << 63, SLOTS, dtype=np.uint64)
_BOUNDS = {bins: np.array([-(-(k << 64) // bins) for k in range(bins)], np.uint64) for _, bins in SIZES}


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Words()
kept_by(__name__, _words.clear)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text. bytes.lower() and split() know A-Z and the gaps 9-13 and 32 only."""
    part: list[list[bytes]] = []
    size = 0
    for text in texts:
        part.append((text or b"").lower().split())
        size += len(text or b"")
        if size >= WORK:
            yield from _sets(part)
            part, size = [], 0
    yield from _sets(part)


def _sets(part: list[list[bytes]]) -> Iterator[np.ndarray]:
    if len(_words) > KEEP:
        _words.clear()
    counts = [len(w) for w in part]
    total = sum(counts)
    words = np.fromiter((h for w in part for h in map(_words.__getitem__, w)), np.uint64, total)
    m = max(0, total - SHINGLE + 1)
    hashes = np.full(m, np.uint64(SHINGLE))
    for k in range(SHINGLE):
        hashes += words[k : k + m] * _FACTORS[k]
    hashes = _mixed(hashes)
    at = 0
    for n in counts:
        if n >= SHINGLE:
            yield np.unique(hashes[at : at + n - SHINGLE + 1])
        elif n:
            yield _mixed(np.array([n], np.uint64) + (words[at : at + n] * _FACTORS[:n]).sum(keepdims=True))
        else:
            yield words[:0]
        at += n


def band_keys(x: np.ndarray) -> np.ndarray:
    """Keys of a set, for its own class of sizes and that of the largest set to which it may be linked: those of even classes first, then those of odd ones, by band; 0 where there is none. So a key of two sets stands at one place in both."""
    out = np.zeros((2, BANDS), np.uint64)
    for kind in sorted({next(k for k, (most, _) in enumerate(SIZES) if n <= most) for n in (len(x), len(x) * 4 // 3)}):
        bins = SIZES[kind][1]
        perms = SLOTS // bins
        y = np.sort((x[None, :] ^ _SHIFTS[:perms, None]) * _PERMS[:perms, None], axis=1)
        if bins == 1:
            slots, full = y[:, 0], np.ones(SLOTS, bool)
        else:
            first = np.stack([np.searchsorted(row, _BOUNDS[bins]) for row in y])
            full = (np.diff(first, axis=1, append=len(x)) > 0).ravel()
            slots = np.where(full, np.take_along_axis(y, np.minimum(first, len(x) - 1), axis=1).ravel(), np.uint64(0))
        slots, full = slots.reshape(ROWS, BANDS), full.reshape(ROWS, BANDS)
        key = np.arange(BANDS, dtype=np.uint64) + np.uint64(kind * BANDS + 1)
        for row in slots:
            key = _mixed(key + row * np.uint64(0x9E3779B97F4A7C15))
        out[kind % 2] = np.where(full.any(axis=0), key, np.uint64(0))
    return out.ravel().view(np.int64)


def prefix_keys(x: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, of which a linked set has one among its own first."""
    return x[: len(x) - -(-3 * len(x) // 4) + 1].view(np.int64)


def bitmap(x: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(x >> np.uint64(17)) & np.uint64(BITS - 1)] = True
    return np.packbits(bits).tobytes()


def _sketch(docs: DataFrame, exact: bool) -> DataFrame:
    keys_of = prefix_keys if exact else band_keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sigs, keys, bits = [], [], [], []
            for x in shingle_sets(batch.column(2).cast(pa.binary()).to_pylist()):
                n.append(len(x))
                sigs.append(xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None)
                keys.append(keys_of(x) if len(x) else None)
                bits.append(bitmap(x) if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary()), batch.column(3)], ["rid", "doc_id", "n", "sig", "keys", "bits", "mark"])

    return mapped(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.xxhash64("text").alias("mark")), run, "rid long, doc_id long, n long, sig binary, keys array<long>, bits binary, mark long")


#: Bytes of texts whose sets a worker keeps between pairs.
KNOWN_BYTES = 16 << 20


def near(n: np.ndarray, m: np.ndarray, xor: np.ndarray) -> np.ndarray:
    """May sets of these sizes and differing bits be linked?"""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) & (7 * xor <= n + m)


def _bound(pairs: DataFrame) -> DataFrame:
    """Of (a, b, n, bits, m, bits_b) the pairs (a, b) that sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, BITS // 64) for k in (3, 5))
            keep = near(np.asarray(batch.column(2)), np.asarray(batch.column(4)), np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64))
            yield batch.select([0, 1]).filter(pa.array(keep))

    return mapped(pairs.select("a", "b", "n", "bits", "m", "bits_b"), run, "a long, b long")


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


def _exact(pairs: DataFrame) -> DataFrame:
    """Of (a, b, text, text_b) the linked pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist(), strict=True):
                if len(known) > 64 or sum(map(len, known)) > KNOWN_BYTES:
                    known.clear()
                for text in (s, t):
                    if text not in known:
                        known[text] = next(shingle_sets([text]))
                keep.append(linked(known[s], known[t]))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return mapped(pairs.select("a", "b", "text", "text_b"), run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame | None, bounded: bool) -> DataFrame:
    """Linked pairs of (a, b); nodes: node, n, bits; texts: node, text."""
    if not bounded:
        left, right = nodes.select(F.col("node").alias("a"), "n", "bits"), nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("bits_b"))
        pairs = _bound(pairs.join(left, "a").join(right, "b"))
    return _exact(pairs.join(texts.select(F.col("node").alias("a"), "text"), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"))


def _tiles(members: DataFrame, once: int | None = None) -> DataFrame:
    """members (key, node, n, ...) with tile, side and lone: rows to compare are those of a tile (on different sides if not lone).

    Groups of at most TILE rows and HELD shingles are one tile. Larger ones are dealt by size band and hash; a tile pair is of one band or of two next to each other.
    With once, the number of a round, each row is in one tile of its key, with rows of its band that are others under each key and in each round: no group's tiles then hold more rows than the group."""
    band = F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int")
    banded = members.withColumn("band", band)
    counts = banded.groupBy("key", "band").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("held"))
    subs = F.ceil(F.greatest(F.col("rows") / TILE, F.least(F.col("held") / HELD, F.col("rows")))).cast("int")
    whole = counts.groupBy("key").agg(((F.sum("rows") <= TILE) & (F.sum("held") <= HELD)).alias("small"), F.map_from_entries(F.collect_list(F.struct("band", subs.alias("subs")))).alias("subs"))  # a size band each: few
    whole = stored(whole, "groups")  # so that the join below has exchanges of its own, which AQE can split
    own = banded.join(whole, "key")
    carried = [c for c in members.columns if c != "key"]
    small = own.filter("small").select(*carried, F.struct("key", F.lit(None).cast("int").alias("band"), F.lit(0).alias("i"), F.lit(0).alias("other"), F.lit(0).alias("j")).alias("tile"), F.lit(0).alias("side"), F.lit(True).alias("lone"))
    large = own.filter("not small").withColumn("i", F.pmod(F.xxhash64("node", *([] if once is None else ["key", F.lit(once)])), F.element_at("subs", F.col("band"))).cast("int"))
    if once is not None:
        return small.unionByName(large.select(*carried, F.struct("key", "band", "i", F.col("band").alias("other"), F.col("i").alias("j")).alias("tile"), F.lit(0).alias("side"), F.lit(True).alias("lone")))
    pair = lambda low, i, high, j, side, lone: F.struct(F.struct("key", low.alias("band"), i.alias("i"), high.alias("other"), j.alias("j")).alias("tile"), side.alias("side"), lone.alias("lone"))
    upto = lambda at: F.sequence(F.lit(0), F.element_at("subs", at) - 1)
    same = F.transform(upto(F.col("band")), lambda j: pair(F.col("band"), F.least(F.col("i"), j), F.col("band"), F.greatest(F.col("i"), j), (F.col("i") > j).cast("int"), F.col("i") == j))
    above, below = F.col("band") + 1, F.col("band") - 1
    none = F.slice(same, 1, 0)
    up = F.when(F.map_contains_key("subs", above), F.transform(upto(above), lambda j: pair(F.col("band"), F.col("i"), above, j, F.lit(0), F.lit(False)))).otherwise(none)
    down = F.when(F.map_contains_key("subs", below), F.transform(upto(below), lambda j: pair(below, j, F.col("band"), F.col("i"), F.lit(1), F.lit(False)))).otherwise(none)
    dealt = large.withColumn("part", F.explode(F.concat(same, up, down))).select(*carried, "part.tile", "part.side", "part.lone")
    return small.unionByName(dealt)


def _compare(rows: list[np.ndarray], nearest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) in one tile that carry different labels and pass the bound; each row is held only against those of like size."""
    node, label, n, bits, side, lone = rows
    order = np.argsort(n, kind="stable")
    node, label, n, bits, side = (x[order] for x in (node, label, n, bits, side))
    first, last = np.searchsorted(4 * n, 3 * n, "left"), np.searchsorted(3 * n, 4 * n, "right")
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // (len(node) * (BITS // 64)))
    for k in range(0, len(node), step):
        here = slice(k, min(k + step, len(node)))
        near_by = slice(int(first[here].min()), int(last[here].max()))
        xor = np.bitwise_count(bits[here, None] ^ bits[None, near_by]).sum(axis=2, dtype=np.int64)
        ok = near(n[here, None], n[None, near_by], xor) & (label[here, None] != label[None, near_by])
        if not lone:
            ok &= side[here, None] != side[None, near_by]
        if nearest:
            far = np.where(ok, xor / (n[here, None] + n[None, near_by]), 2.0)
            best = far.argmin(axis=1)
            i = np.flatnonzero(far[np.arange(len(best)), best] < 2)
            j = best[i]
        else:
            i, j = np.nonzero(ok)
        found.append((node[i + k], node[j + near_by.start]))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def _by_tile(members: DataFrame, more: DataFrame, columns: list[str], work, schema: str, once: int | None = None) -> DataFrame:
    """work(rows of one tile) for every tile of members, one after the other; a tile has 2 * TILE rows or so.

    more: what is long of each node (bitmaps, keys, texts). It joins rows that have their tile, so it moves once by node, and once to each tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = np.asarray(batch.column(0))
            cuts = [0, *(np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist(), len(tile)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and tile[a] != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = tile[a]
        if held:
            yield work(pa.Table.from_batches(held))

    tiles = _tiles(members, once).withColumn("tile", F.xxhash64("tile")).join(more, "node")
    return mapped(tiles.repartition("tile").sortWithinPartitions("tile").select("tile", *columns, "side", "lone"), run, schema)


def _bits(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)


def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key that each row of x has in common with that of y at the same place, 0 if none."""
    same = (x == y) & (x != 0)
    at = same.argmax(axis=1)
    rows = np.arange(len(x))
    return np.where(same[rows, at], x[rows, at], 0)


def _by_place(places: pa.ChunkedArray, keys: pa.ChunkedArray) -> np.ndarray:
    """A row of 2 * BANDS keys from each list of keys and that of their places; 0 where there is none."""
    places, keys = places.combine_chunks(), keys.combine_chunks()
    out = np.zeros((len(keys), 2 * BANDS), np.int64)
    out[np.repeat(np.arange(len(keys)), keys.value_lengths()), places.flatten()] = keys.flatten()
    return out


def _candidates(members: DataFrame, nodes: DataFrame, once: int | None = None, exact: bool = False) -> DataFrame:
    """Different pairs (a, b) of members (key, place, node, label, n) that share a key, carry different labels and pass the bound; with once (see _tiles) of each class in its tile only its nearest.

    Pairs have many band keys in common, copies nearly all of them: a pair leaves the tile of the first of these alone. Classes of different labels have no key in common that isn't in members,
    so a class brings only its keys there, a few of all."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        node = np.asarray(rows["node"])
        a, b = _compare([node, np.asarray(rows["label"]), np.asarray(rows["n"]), _bits(rows), np.asarray(rows["side"]), bool(rows["lone"][0].as_py())], once is not None)
        if not exact:
            own, met = _by_place(rows["places"], rows["keys"]), np.asarray(rows["met"])
            order = np.argsort(node, kind="stable")
            i, j = (order[np.searchsorted(node, x, sorter=order)] for x in (a, b))
            first = [first_shared(own[i[k : k + PAIRS]], own[j[k : k + PAIRS]]) for k in range(0, len(a), PAIRS)]
            keep = np.concatenate([np.zeros(0, np.int64), *first]) == met[i]
            a, b = a[keep], b[keep]
        a, b = np.unique(np.stack([a, b]), axis=1)  # found from both sides
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    bits = nodes.select("node", "bits")
    if exact:
        return _by_tile(members.select("key", "node", "label", "n"), bits, ["node", "label", "n", "bits"], work, "a long, b long", once).distinct()
    held = members.groupBy("node").agg(F.collect_list(F.struct("place", "key")).alias("held"))  # a class has 2 * BANDS keys at most
    more = bits.join(held.select("node", F.col("held.place").alias("places"), F.col("held.key").alias("keys")), "node")
    return _by_tile(members.select("key", "node", "label", "n", F.col("key").alias("met")), more, ["node", "label", "n", "bits", "places", "keys", "met"], work, "a long, b long", once).distinct()


def _links_of_tile(rows: pa.Table) -> pa.RecordBatch:
    """node, links: how many documents the classes of a tile are linked with in it."""
    lone = bool(rows["lone"][0].as_py())
    rows = rows.sort_by("n")
    node, n, size, side = (np.asarray(rows[c]) for c in ("node", "n", "size", "side"))
    bits, links = _bits(rows), np.zeros(len(rows), np.int64)
    last = np.searchsorted(3 * n, 4 * n, "right")
    sets: list[np.ndarray | None] = list(shingle_sets(rows["text"].cast(pa.binary()).to_pylist()))
    every, local = np.unique(np.concatenate(sets), return_inverse=True)
    sets.clear()
    ids, mark = np.split(local.astype(np.int32), np.cumsum(n)[:-1]), np.zeros(len(every), bool)
    del every, local
    for i in range(len(rows)):
        above = slice(i + 1, int(last[i]))
        ok = near(n[i], n[above], np.bitwise_count(bits[i] ^ bits[above]).sum(axis=1, dtype=np.int64))
        if not lone:
            ok &= side[above] != side[i]
        others = np.flatnonzero(ok) + i + 1
        if not len(others):
            continue
        mark[ids[i]] = True
        both = np.fromiter((np.count_nonzero(mark[ids[j]]) for j in others), np.int64, len(others))
        mark[ids[i]] = False
        found = others[100 * both >= 75 * (n[i] + n[others] - both)]
        links[i] += size[found].sum()
        links[found] += size[i]
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], ["node", "links"])


class Classes(NamedTuple):
    """documents: rid, doc_id, n, sig of each row. kinds: sig, node, low (smallest doc_id), size (rows) and label of each different set; sets of one label are connected by links. nodes: node, n, bits. texts: node and text of the sets that may have links."""

    documents: DataFrame
    kinds: DataFrame
    nodes: DataFrame
    texts: DataFrame


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> Classes:
    """Classes of equal sets, and how links connect them."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = stored(_sketch(own, exact), "sketches")
    rows = sketches.count()
    kinds = stored(sketches.filter("n > 0").groupBy("sig").agg(F.min("rid").alias("node"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("size")), "classes", rows)
    nodes = stored(sketches.join(kinds.select(F.col("node").alias("rid")).hint("merge"), "rid", "left_semi").withColumnRenamed("rid", "node"), "nodes")
    documents = stored(sketches.select("rid", "doc_id", "n", "sig"), "documents")
    drop_stored(sketches)
    keyed = nodes.select("node", "n", F.posexplode("keys").alias("place", "key"))
    keyed = keyed.withColumn("place", F.lit(0) if exact else F.col("place"))
    keyed = keyed if exact else keyed.filter("key <> 0")
    shared = keyed.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot")
    met = stored(keyed.join(shared.hint("merge"), "key"), "met")
    star = met.filter("node <> pivot").groupBy("node", "pivot").count().groupBy("node").agg(F.max(F.struct("count", -F.col("pivot"))).alias("best"))
    star = stored(star.select(F.col("node").alias("a"), (-F.col("best.col2")).alias("b")), "star", rows)
    met_nodes = met.select("node").distinct().join(nodes.select("node", "doc_id", "sig", "mark"), "node")
    texts = stored(_texts(own, met_nodes), "texts")
    links = stored(_verified(star, nodes, texts, False), "links", rows)
    drop_stored(star)
    labels = components(links, "labels", rows)
    drop_stored(links)
    once: int | None = 0  # the round of nearest ones, None for all that are left
    while True:
        whole = met.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = whole.groupBy("key").agg(F.min("label").alias("first"), F.max("label").alias("last")).filter("first < last").select("key")
        members = stored(whole.select("key", "place", "node", "label", "n").join(mixed, "key", "left_semi"), "mixed")
        pairs = stored(_candidates(members, nodes, once, exact), "pairs")
        if not (n_pairs := pairs.count()):
            drop_stored(members, pairs)
            if once is None:
                break
            once = None  # others may have met elsewhere
            continue
        more = stored(_verified(pairs, nodes, texts, True), "links", n_pairs)
        drop_stored(members, pairs)
        n_more, last = more.count(), once is None
        once = once + 1 if once is not None and 2 * n_more >= n_pairs else None
        if not n_more:
            drop_stored(more)
            if last:
                break
            continue
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        joined = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b"))
        higher = components(joined, "labels", n_pairs)
        every = labels.unionByName(more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
        merged = stored(every.join(higher.select(F.col("node").alias("label"), F.col("label").alias("higher")), "label", "left").select("node", F.coalesce("higher", "label").alias("label")), "labels", rows)
        drop_stored(labels, more, higher)
        labels = merged
        if last:
            break
    labelled = stored(kinds.join(labels, "node", "left").select("sig", "node", "low", "size", F.coalesce("label", "node").alias("label")), "labelled", rows)
    drop_stored(kinds, met, labels)
    return Classes(documents, labelled, nodes.select("node", "n", "bits"), texts)


def link_counts(found: Classes) -> DataFrame:
    """node, links: the number of documents of other classes that each class is linked with (classes without any are left out).

    Links never leave a component, so the classes of a component are dealt into tiles, each with its text once for each pair of tiles, and what a
    tile counts is added up; no pair is ever a row."""
    inside = found.kinds.withColumnRenamed("label", "key").join(found.kinds.groupBy(F.col("label").alias("key")).agg(F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("key"), "key", "left_semi")
    members = stored(inside.select("key", "node", "size").join(found.nodes.select("node", "n"), "node"), "members")
    more = found.nodes.select("node", "bits").join(found.texts, "node").join(members.select("node"), "node", "left_semi").dropDuplicates(["node"])  # rows that repeat a document give its text twice
    return _by_tile(members, more, ["node", "n", "size", "bits", "text"], _links_of_tile, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _texts(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the classes in nodes (node, doc_id, sig, mark). Rows meet by id and mark, a hash of the text, so rows that share an id (or have none) don't all meet each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(2).cast(pa.binary()).to_pylist())
            keep = [xxhash.xxh3_128_digest(x.tobytes()) == sig for x, sig in zip(sets, batch.column(1).to_pylist(), strict=True)]
            yield batch.select([0, 2]).filter(pa.array(keep, pa.bool_()))

    wanted = nodes.select("node", F.col("doc_id").alias("node_id"), "sig", F.col("mark").alias("node_mark")).hint("merge")
    met = own.withColumn("mark", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("node_id")) & (F.col("mark") == F.col("node_mark")))
    return mapped(met.select("node", "sig", "text"), run, "node long, text string")


def connected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles and component_id of each row; with counts also n_links, the number of other rows that it is linked with."""
    found = classes(docs, id_col, text_col, exact)
    lows = found.kinds.groupBy("label").agg(F.min("low").alias("component_id"))
    of = found.kinds.join(lows, "label").select("sig", "node", "size", "component_id")
    of = of.join(link_counts(found), "node", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("size") - 1) if counts else of.select("sig", "component_id")
    of = stored(of.drop("node", "size", "links"), "counted", found.kinds.count())
    drop_stored(found.kinds, found.nodes, found.texts)
    out = found.documents.join(of, "sig", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")]
    return out.select(*columns, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if counts else []))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs of which one in each component stays: that with the smallest id (rows that repeat it stay too, and rows without an id). Columns stay as they are."""
    gone = connected(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    kept = own.join(gone.hint("merge"), own[names[docs.columns.index(id_col)]].cast("long") == F.col("gone_id"), "left_anti")
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op7_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's set size, component of near copies, and number of links."""
    return connected(table(spark, sf_dir, "documents"), counts=True)


OP7_SQL = r"""
WITH RECURSIVE cut AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
held AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM cut WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_.n >= 75 * (x.n + y.n - both_.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM edges GROUP BY a) USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""
