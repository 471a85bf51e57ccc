"""Byte-level BPE: encoding and decoding with a public vocabulary.

Merges are found with a segment tree over the ranks of adjacent pairs: a leaf holds (rank, position) of the pair that
starts there, so the root is the leftmost pair of the lowest rank; a merge changes three leaves, each a walk of
logarithmic length; a pre-token is finished when its root holds no pair. Trees of many pre-tokens of like length are
rows of one matrix, and a round merges once in each of them. Only pre-tokens not yet known to the worker are encoded.

Every document is by itself: a scan, one Python stage and no shuffle. A lost executor costs its running tasks.

Defined results: null text counts as empty and gives no tokens; texts of any length are encoded whole (a pre-token of n bytes takes
O(n log n) steps and about 80 n bytes of memory while it is merged: an unbroken run of 10 MB takes 0.8 GB); ties of rank go to the leftmost
pair; repeated rows each get a row; an empty table gives an empty result; other columns, whatever their names, are not read (encode_column() passes them on).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_by, mapped, table

#: Above every rank (ids and ranks have 20 bits), and so small that NONE * leaves fits 64 bits for any text.
NONE = np.int64(1) << 20


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A vocabulary file of the tokenizers library (byte-level, without prefix space)."""

    #: Pre-tokens of a generation (a worker keeps two: what was met of late stays), and characters of text that it works on at once.
    KEEP, AT_ONCE = 60_000, 1 << 19

    def __init__(self, path: str, pattern: str | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        letters = byte_letters()
        to_byte = {v: k for k, v in letters.items()}
        self.split = regex.compile(pattern).findall
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        raw = {i: bytes(map(to_byte.__getitem__, t)) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes_of = {str(i): b for i, b in raw.items()}
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair doesn't merge (or an id is -1)."""
        want = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where((self.pairs[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def _forest(self, words: list[bytes], leaves: int) -> list[np.ndarray]:
        """Ids of words of 2 to leaves + 1 bytes; leaves is a power of 2."""
        n, width = len(words), leaves + 1
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width), -1, np.int64)
        inside = np.arange(width) < size[:, None]
        ids[inside] = self.first[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(np.arange(1, width + 1) < size[:, None], np.arange(1, width + 1), -1).astype(np.int64)
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        tree = np.full((n, 2 * leaves), NONE * leaves, np.int64)
        spot = np.arange(leaves)
        tree[:, leaves:] = self.rank(ids[:, :-1], ids[:, 1:]) * leaves + spot
        node = leaves
        while node > 1:
            node //= 2
            tree[:, node : 2 * node] = np.minimum(tree[:, 2 * node : 4 * node : 2], tree[:, 2 * node + 1 : 4 * node : 2])
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        rows = np.arange(n)
        while True:
            root = tree_[rows * (2 * leaves) + 1]
            rows, root = rows[root < NONE * leaves], root[root < NONE * leaves]
            if not len(rows):
                break
            base, trunk, left = rows * width, rows * (2 * leaves), root % leaves
            right = after_[base + left]
            ids_[base + left] = self.merged[root // leaves]
            ids_[base + right] = -1
            beyond = after_[base + right]
            after_[base + left] = beyond
            has = beyond >= 0
            before_[base[has] + beyond[has]] = left[has]
            ahead = before_[base + left]
            # the pairs that start at left and ahead have changed, that at right is gone
            tree_[trunk + leaves + left] = np.where(has, self.rank(ids_[base + left], ids_[base + np.maximum(beyond, 0)]), NONE) * leaves + left
            led = ahead >= 0
            tree_[trunk[led] + leaves + ahead[led]] = self.rank(ids_[base[led] + ahead[led]], ids_[base[led] + left[led]]) * leaves + ahead[led]
            ends = right < leaves
            tree_[trunk[ends] + leaves + right[ends]] = NONE * leaves
            for trunks, leaf in ((trunk, left), (trunk[led], ahead[led]), (trunk[ends], right[ends])):
                node = (leaves + leaf) >> 1
                for _ in range(leaves.bit_length() - 1):
                    tree_[trunks + node] = np.minimum(tree_[trunks + 2 * node], tree_[trunks + 2 * node + 1])
                    node >>= 1
        return [row[row >= 0] for row in ids]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, without pre-tokenisation."""
        out: list[np.ndarray] = [self.first[:0]] * len(words)
        sized: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) == 1:
                out[i] = self.first[[w[0]]]
            elif w:
                sized.setdefault(1 << (len(w) - 2).bit_length(), []).append(i)
        for leaves, which in sized.items():
            step = max(1, (1 << 17) // leaves)
            for k in range(0, len(which), step):
                part = which[k : k + step]
                for i, ids in zip(part, self._forest([words[j] for j in part], leaves), strict=True):
                    out[i] = ids
        return out

    def joined(self, texts: Iterable[str | None]) -> Iterator[str]:
        """For each text its ids in decimal, joined by commas."""
        group: list[list[list[str] | str]] = []
        size = 0
        for text in texts:
            text = text or ""
            group.append([part if k % 2 else self.split(part) for k, part in enumerate(self.cut(text))] if self.cut else [self.split(text)])
            size += len(text)
            if size >= self.AT_ONCE:
                yield from self._join(group)
                group, size = [], 0
        yield from self._join(group)

    def _join(self, group: list[list[list[str] | str]]) -> Iterator[str]:
        if len(self.known) > self.KEEP:
            self.known, self.older = {}, self.known
        met = set().union(*(p for parts in group for p in parts if isinstance(p, list))) - self.known.keys()
        again = met & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = list(met - again)
        for word, ids in zip(new, self.encode_words([w.encode("utf-8", "surrogatepass") for w in new]), strict=True):
            self.known[word] = ",".join(map(str, ids.tolist()))
        of = self.known.__getitem__
        for parts in group:
            yield ",".join([str(self.special[p]) if isinstance(p, str) else ",".join(map(of, p)) for p in parts if p])

    def encode(self, texts: Iterable[str | None]) -> Iterator[list[int]]:
        return ([int(x) for x in ids.split(",")] if ids else [] for ids in self.joined(texts))

    def decode_joined(self, ids: str) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_joined(",".join(map(str, ids)))


_loaded: dict[str, Bpe] = {}
kept_by(__name__, _loaded.clear)


def loaded(path: str) -> Bpe:
    """The vocabulary, once in each worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_column(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """docs with the token ids of a text column, as an array of int."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            ids = pa.array(bpe.encode(batch.column("__text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "__ids"])

    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    source = named.withColumn("__text", F.col(f"c{docs.columns.index(text_col)}"))
    schema = ", ".join([*(f"{n} {t}" for n, t in named.dtypes), "__ids array<int>"])
    return mapped(source, run, schema).toDF(*docs.columns, out_col)


def digest_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document the number of tokens and digests of its ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.joined(batch.column(1).to_pylist()):
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode_joined(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its token ids, and whether they decode to its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts, n, ids, same = batch.column(1).to_pylist(), [], [], []
            for text, joined in zip(texts, bpe.joined(texts), strict=True):
                ids.append(np.array(joined.split(","), np.int32) if joined else np.zeros(0, np.int32))
                n.append(len(ids[-1]))
                same.append(bpe.decode_joined(joined) == (text or ""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "decodes"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, ids array<int>, decodes boolean")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole document and the text decoded from them, as digests."""
    return digest_rows(table(spark, sf_dir, "documents"), vocabulary())
