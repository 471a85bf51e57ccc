"""Token counts under a unigram model, by dynamic programming over a shared trie.

The pieces are those of a public byte-level vocabulary. A piece's log-probability is its share of the tokens into which the public
tokenizer cuts all documents, each piece counting PRIOR beforehand; in whole numbers of
2**-16, so that sums are exact. The tokenizer never merges beyond a pre-token, so all pre-tokens are counted first and each different one is cut once. The vocabulary itself is never changed. Pre-tokens that a worker doesn't know are inserted in a trie of bytes; a
node holds the forward score of its prefix, the best over all last pieces of (score of the prefix before, score of
the piece), and how many pieces that takes; so a shared prefix is computed once. Last pieces are found by a walk back through a trie of reversed
pieces, for all nodes of a depth at a time. Where a pre-token ends, the number is its count, and a document's count is the sum over its pre-tokens. Of equal scores the
segmentation with fewer pieces wins.

Every document is by itself: two scans, one Python stage in each, and no shuffle but that of the counts of different pre-tokens. A trie is that of the
new pre-tokens of WORK characters; a worker keeps the counts of KEEP pre-tokens, and those of the generation before. Pre-tokens of over LONG bytes are counted without a trie, in memory that doesn't grow with them. A lost executor
costs its running tasks.

Defined results: null text counts as empty and has 0 tokens; texts and pre-tokens of any length are counted whole; special
tokens in a text are ordinary text; repeated rows each get a row; documents without an id don't count for the model; an empty table gives an
empty result (and a model of equal pieces); other columns are not read.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter as Counts, deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import kept_by, mapped, table

PRIOR = 0.5
UNIT = 1 << 16
#: A score carries the number of pieces in its low bits, negative, so that one maximum decides by both.
PIECE = 1 << 32
#: Less than any score, and still a long when a score is added.
NONE = -(1 << 62)
#: Pre-tokens of a generation (a worker keeps two: what was met of late stays); bytes from which a pre-token is counted by itself; characters of text that a worker works on at once.
KEEP, LONG, WORK = 200_000, 128, 1 << 20
#: Different pre-tokens, and characters of them, that a worker counts before it gives them out.
COUNTED, LETTERS = 200_000, 1 << 23


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """regex's findall of a pattern. Texts without characters beyond U+FFFF are cut by Python's re, at less than half the time, where the pattern's only classes are letters,
    numbers and blanks: they are spelt out as regex knows them."""
    slow = regex.compile(pattern).findall
    if re.search(r"\\(?!p\{[LN]\}|[sS])|\(\?(?![!=:])", pattern):
        return slow
    every, spelt = "".join(map(chr, range(1 << 16))), {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        at = [m.span() for m in regex.finditer(f"{name}+", every)]
        spelt[name] = "".join(f"\\u{a:04x}-\\u{b - 1:04x}" for a, b in at)
    inside = lambda text: re.sub(r"\\p\{[LN]\}|\\s", lambda m: spelt[m[0]], text)
    plain = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}|\\s|\\S", lambda m: inside(m[0]) if m[0][0] == "[" else f"[^{spelt[r'\s']}]" if m[0] == r"\S" else f"[{spelt[m[0]]}]", pattern)
    if "\\S" in plain:  # within brackets
        return slow
    fast, beyond = re.compile(plain).findall, re.compile("[^\0-\uffff]").search
    return lambda text: fast(text) if text.isascii() or not beyond(text) else slow(text)


def fit(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """How often the tokenizer's own segmentation of all documents has each piece, by id."""
    own = docs.filter(F.col(id_col).cast("long").isNotNull()).select(F.col(text_col).alias("fit_text"))
    size = len(_spec(path))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, counts = bpe.loaded(path), np.zeros(size, np.int64)
        for batch in batches:
            cut = tokenizer.encode_words([w.encode("utf-8", "surrogatepass") for w in batch.column(0).to_pylist()])
            often = np.repeat(np.asarray(batch.column(1)), [len(ids) for ids in cut])
            np.add.at(counts, np.concatenate([np.zeros(0, np.int64), *cut]), often)
        piece = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(counts[piece])], ["piece", "n"])

    counts = np.zeros(size, np.int64)
    for row in mapped(pretoken_counts(own, path), pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # a row a piece at most
        counts[row["piece"]] = row["n"]
    return counts


def pretoken_counts(texts: DataFrame, path: str) -> DataFrame:
    """word and n of every different pre-token of a column of texts; special tokens are none."""
    import public_tokenizers

    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(pattern)
        cut = regex.compile("|".join(map(regex.escape, special))).split if special else lambda text: [text]
        seen: Counts[str] = Counts()
        letters = 0
        for batch in batches:
            for text in batch.column(0):
                for part in cut(text.as_py() or ""):
                    known = len(seen)
                    seen.update(split(part))
                    letters += len(part) if len(seen) > known else 0
                if len(seen) >= COUNTED or letters >= LETTERS:
                    yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})
                    seen, letters = Counts(), 0
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen, pa.string()), "n": pa.array(seen.values(), pa.int64())})

    return mapped(texts, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _spec(path: str) -> dict[int, bytes | None]:
    """The bytes of each id; None for special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["id"] for t in spec["added_tokens"]}
    to_byte = {v: k for k, v in bpe.byte_letters().items()}
    found = {i: None if i in special else bytes(map(to_byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items()} | dict.fromkeys(special)
    return {i: found.get(i) for i in range(max(found) + 1)}


class Unigram:
    """Log-probabilities of the pieces of a vocabulary file of the tokenizers library (byte-level); counts: of each id."""

    def __init__(self, path: str, counts: np.ndarray | None = None):
        pieces = {i: b for i, b in _spec(path).items() if b}
        given = np.zeros(max(pieces) + 1) if counts is None else counts
        total = sum(float(given[i]) + PRIOR for i in pieces)
        self.score = {b: round(math.log((float(given[i]) + PRIOR) / total) * UNIT) * PIECE - 1 for i, b in pieces.items()}
        self.longest = max(map(len, self.score))
        #: The trie of reversed pieces: child of (node, byte), and the score of the piece that a node stands for.
        self.back: dict[int, int] = {}
        self.ends: list[int | None] = [None]
        for piece, value in self.score.items():
            node = 0
            for byte in reversed(piece):
                edge = node << 8 | byte
                node = self.back.get(edge, 0)
                if not node:
                    node = self.back[edge] = len(self.ends)
                    self.ends.append(None)
            self.ends[node] = value


class Trie:
    """Forward scores of all prefixes of the words of the last insert_all()."""

    def __init__(self, model: Unigram):
        self.model, self.forward = model, np.zeros(1, np.int64)
        edges = np.array(list(model.back), np.int64)
        order = np.argsort(edges)
        self.edges, self.child = edges[order], np.array(list(model.back.values()), np.int64)[order]
        self.ends = np.array([NONE if x is None else x for x in model.ends], np.int64)

    def insert(self, word: bytes) -> int:
        """The number of pieces of the word's best segmentation."""
        return self.insert_all([word])[0]

    def insert_all(self, words: list[bytes]) -> list[int]:
        """The same of many words, of at most 512 bytes each (scores are longs)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        letters, first = np.frombuffer(b"".join(words), np.uint8), (np.cumsum(size) - size)[order]
        parent, letter, forward = (np.zeros(len(letters) + 1, np.int64) for _ in range(3))
        node, made = np.zeros(len(words), np.int64), 1
        for depth in range(int(size.max(initial=0))):
            going = int((size > depth).sum())  # the longest come first
            edge, at = np.unique(node[:going] << 8 | letters[first[:going] + depth], return_inverse=True)
            new = np.arange(made, made + len(edge))
            parent[new], letter[new] = edge >> 8, edge & 255
            forward[new] = self._best(new, parent, letter, forward)
            node[:going] = made + at
            made += len(edge)
        self.forward = forward[:made]
        out = np.empty(len(words), np.int64)
        out[order] = -forward[node] % PIECE
        return out.tolist()

    def _best(self, new: np.ndarray, parent: np.ndarray, letter: np.ndarray, forward: np.ndarray) -> np.ndarray:
        """Forward scores of nodes whose ancestors have theirs: all walk back at once."""
        best, rows, node, at = np.full(len(new), NONE), np.arange(len(new)), new, np.zeros(len(new), np.int64)
        while len(rows):
            edge = at << 8 | letter[node]
            spot = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
            some = self.edges[spot] == edge
            rows, node, at = rows[some], parent[node[some]], self.child[spot[some]]
            best[rows] = np.maximum(best[rows], forward[node] + self.ends[at])
            inner = node > 0
            rows, node, at = rows[inner], node[inner], at[inner]
        return best

    def alone(self, word: bytes) -> int:
        """The same without a node: only the scores that a piece can reach back to are held."""
        back, ends = self.model.back, self.model.ends
        scores = deque([0], maxlen=self.model.longest)
        for i in range(len(word)):
            best, at = None, 0
            for start in range(i, -1, -1):
                at = back.get(at << 8 | word[start])
                if at is None:
                    break
                piece = ends[at]
                if piece is not None:
                    value = scores[start - i - 1] + piece
                    if best is None or value > best:
                        best = value
            scores.append(best)
        return -scores[-1] % PIECE


class Counter:
    """Token counts of texts; keeps the counts of known pre-tokens."""

    def __init__(self, path: str, counts: np.ndarray | None = None, pattern: str | None = None):
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        self.split = splitter(pattern)
        self.model = Unigram(path, counts)
        self.trie = Trie(self.model)
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def counts(self, texts: Iterable[str | None]) -> Iterator[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        group: list[list[str]] = []
        size = 0
        for text in texts:
            group.append(self.split(text or ""))
            size += len(text or "")
            if size >= WORK:
                yield from self._count(group)
                group, size = [], 0
        yield from self._count(group)

    def _count(self, group: list[list[str]]) -> Iterator[tuple[int, int]]:
        if len(self.known) > KEEP:
            self.known, self.older = {}, self.known
        met = set().union(*group) - self.known.keys()
        again = met & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        long, short = {}, {}
        for word in met - again:
            raw = word.encode("utf-8", "surrogatepass")
            if len(raw) > LONG:
                long[word] = self.trie.alone(raw)
            else:
                short[word] = raw
        if short:
            self.known.update(zip(short, self.trie.insert_all(list(short.values())), strict=True))
        of = (self.known | long if long else self.known).__getitem__
        return [(sum(map(of, words)), len(words)) for words in group]


_loaded: dict[bytes, Counter] = {}
kept_by(__name__, _loaded.clear)


def loaded(path: str, counts: np.ndarray) -> Counter:
    """The counter of a vocabulary and a model, once in each worker."""
    key = path.encode() + counts.tobytes()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(path, counts)
    return _loaded[key]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and n_pretokens of each row."""
    counts = fit(docs, path, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path, counts)
        for batch in batches:
            both = list(counter.counts(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in both], pa.int64()) for k in (0, 1))], ["doc_id", "n_tokens", "n_pretokens"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long, n_pretokens long")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of every whole document."""
    return token_counts(table(spark, sf_dir, "documents"), bpe.vocabulary())
