"""Quality classifier by importance resampling.

Two generative models over hashed n-grams: the target (labelled good text, of FIT_ROWS rows at most, those whose ids hash
lowest) and the raw corpus (every document, in full). Four kinds of gram have models of their own: tokens (a run of letters
and digits, or of other marks) and pairs of tokens that follow each other, hashed to 2 ** CELL_BITS cells, and how many places before
the same token, and the same pair, was last met in the text (powers of two). The log-ratio of the two models, summed over the grams of a document and divided by the
square root of their number, is its log importance weight: what chance makes of clean text is then of like size for short and long texts.

Documents are drawn without replacement by Gumbel top-k, from the weights to the power of 1 / HEAT. k is a share of the documents: that of the
good ones among all labelled documents, at the upper end of its confidence interval of SIGMAS standard errors: one, so that an error
of the share seldom costs clean text, and little junk takes its place. HEAT is 1: noise of about 1.3 meets log weights of which clean text has -1 to 2 and junk -8 to -40, so what lies
between is drawn by lot, and no threshold on the weight gives the same documents.

Counts are partial for each partition, hence CELLS rows a partition at most move, and the model that goes to the executors has CELLS entries whatever
the input. Log-ratios are whole numbers of 2**-16, so sums don't depend on how rows are dealt out. No document moves: two scans (counts, scores),
and the k-th key is found by counting.

Defined results: null or empty text has no gram and log weight 0; texts are read whole, in pieces of PIECE bytes (grams across two pieces
don't count); equal keys at the threshold all stay; rows of a repeated doc_id share their noise; an empty table gives an empty result; labels
without a document, null labels and repeated labels are of no effect; without labels all rows stay; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, kth_largest, mapped, sortable, stored, table, uniform

FIT_ROWS, HEAT, SIGMAS, SEED = 4000, 1.0, 1.0, 20240
CELL_BITS, GAP_BITS = 14, 4
HASHED = 2 << CELL_BITS
CELLS = HASHED + (2 << (GAP_BITS + 1))
#: First and last cell of each kind of gram.
KINDS = [(0, 1 << CELL_BITS), (1 << CELL_BITS, HASHED), (HASHED, HASHED + (2 << GAP_BITS)), (HASHED + (2 << GAP_BITS), CELLS)]
#: Grams of each cell that the target has beforehand, dealt as those of the raw text are; and the least share of a cell, of the mean one.
PRIOR, SMOOTH = 1.0, 0.01
#: Bytes of text that a task works on at once, and of a piece of a long text.
WORK = PIECE = 1 << 18

SPACES, WORDS, MARKS = 0, 1, 2


def _kinds_of_bytes() -> np.ndarray:
    kind = np.full(256, MARKS, np.uint8)
    kind[[32, *range(9, 14)]] = SPACES
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = WORDS
    return kind


_KIND = _kinds_of_bytes()
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _cell(values: np.ndarray, kind: int) -> np.ndarray:
    return ((values * _ODD) >> np.uint64(64 - CELL_BITS)).astype(np.int64) + KINDS[kind][0]


def _recency(values: np.ndarray, text: np.ndarray, kind: int) -> np.ndarray:
    """Cells of how many places before each value was last met in its text, and whether the value before it came as many places after its like."""
    order = np.lexsort((values, text))
    same = (values[order[1:]] == values[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    gap = np.zeros(len(values), np.int64)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    steady = np.zeros(len(values), np.int64)
    steady[1:] = (gap[1:] == gap[:-1]) & (gap[1:] > 0) & (text[1:] == text[:-1])
    return KINDS[kind][0] + (np.minimum(np.frexp(gap.astype(np.float64))[1], (1 << GAP_BITS) - 1) << 1 | steady)


def grams(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, cells) of all grams of joined texts, kind by kind; ends: of each text; text: its number."""
    kind = _KIND[data]
    begins = np.zeros(len(data), bool)
    begins[:1] = True
    begins[1:] = kind[1:] != kind[:-1]
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins)
    if not len(starts):
        return
    lengths = np.diff(starts, append=len(data))
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    token = np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * _PLACE[place & 63], starts)
    token = (token ^ (token >> np.uint64(31))) * _ODD
    solid = kind[starts] != SPACES
    token, text = token[solid], np.searchsorted(ends, starts[solid], "right")
    if not len(token):
        return
    yield text, _cell(token, 0)
    yield text, _recency(token, text, 2)
    next_to = np.flatnonzero(text[1:] == text[:-1])
    pair = token[next_to] * np.uint64(3) + token[next_to + 1]
    pair ^= pair >> np.uint64(29)
    if len(pair):
        yield text[next_to], _cell(pair, 1)
        yield text[next_to], _recency(pair, text[next_to], 3)


def joined(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, rows) of runs of pieces of a string column: where each piece ends, and its row."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + WORK, "right")) - 1)
        if stop == row + 1:
            for at in range(offsets[row], max(offsets[stop], offsets[row] + 1), PIECE):
                part = data[at : min(at + PIECE, offsets[stop])]
                yield part, np.array([len(part)]), np.array([row])
        else:
            yield data[offsets[row] : offsets[stop]], offsets[row + 1 : stop + 1] - offsets[row], np.arange(row, stop)
        row = stop


def _count(docs: DataFrame, good: str, text: str) -> DataFrame:
    """cell, raw and target counts over docs, of which those with `good` set are the target sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            chosen = np.asarray(pc.fill_null(batch.column(1), False))
            for data, ends, rows in joined(batch.column(0)):
                picked = chosen[rows]
                for text, cells in grams(data, ends):
                    raw += np.bincount(cells, minlength=CELLS)
                    if picked.any():
                        target += np.bincount(cells[picked[text]], minlength=CELLS)
        cell = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(raw[cell]), pa.array(target[cell])], ["cell", "raw", "target"])

    return mapped(docs.select(text, good), run, "cell long, raw long, target long").groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, which: Column | None = None) -> np.ndarray:
    """Log-ratio of each cell, target over raw, in 2**-16. which: labels that may be used (default: all)."""
    good = labels.filter((F.col(label_col) == 1) & (F.lit(True) if which is None else which)).select(F.col(id_col).cast("long").alias("good_id")).filter("good_id is not null").distinct()
    good = good.orderBy(F.xxhash64("good_id", F.lit(SEED)), "good_id").limit(rows)  # bounded by rows, so it may be broadcast
    own = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).alias("own_text"))
    counted = _count(own.join(F.broadcast(good), F.col("own_id") == F.col("good_id"), "left").select("own_text", F.col("good_id").isNotNull().alias("good")), "good", "own_text").collect()
    raw, target = np.zeros(CELLS), np.zeros(CELLS)
    for row in counted:
        raw[row["cell"]], target[row["cell"]] = row["raw"], row["target"]
    if not target.sum():
        return np.zeros(CELLS, np.int64)
    ratio = np.zeros(CELLS)
    for a, b in KINDS:
        if raw[a:b].sum():
            of_raw = (raw[a:b] + SMOOTH * raw[a:b].mean()) / (raw[a:b].sum() * (1 + SMOOTH))
            ratio[a:b] = np.log((target[a:b] + PRIOR * (b - a) * of_raw) / (target[a:b].sum() + PRIOR * (b - a)) / of_raw)
    return np.rint(ratio * 65536).astype(np.int64)


def share(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", which: Column | None = None, sigmas: float = SIGMAS) -> float:
    """The share of good ones among the labelled documents, at the upper end of its confidence interval (Wilson); 1 without labels."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & (F.lit(True) if which is None else which)).select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("good")).distinct()
    known = usable.join(docs.select(F.col(id_col).cast("long").alias("label_id")), "label_id", "left_semi")
    n, good = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("good"), F.lit(0))).first()
    if not n:
        return 1.0
    p, z = good / n, sigmas**2 / n
    return min(1.0, (p + z / 2 + sigmas * math.sqrt(p * (1 - p) / n + z / (4 * n))) / (1 + z))


def log_weights(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """The log importance weight of each text."""
    total, number = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for data, ends, rows in joined(column):
        for text, cells in grams(data, ends):
            counts = np.bincount(text, minlength=len(rows))
            sums = np.concatenate([[0], np.cumsum(model[cells])])
            last = np.cumsum(counts)
            total[rows] += sums[last] - sums[last - counts]
            number[rows] += counts
    return total / 65536.0 / np.sqrt(np.maximum(number, 1))


def scored(docs: DataFrame, model: np.ndarray, text_col: str = "text", out_col: str = "log_weight") -> DataFrame:
    """docs with the log importance weight of each row."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(log_weights(batch.column(at), model))], [*batch.schema.names, "weight"])

    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    schema = ", ".join([*(f"{n} {t}" for n, t in named.dtypes), "weight double"])
    return mapped(named, run, schema).toDF(*docs.columns, out_col)


def gumbel_key(log_weight: Column, ident: Column, heat: float = HEAT, seed: int = SEED) -> Column:
    """The key by which the largest k are a sample without replacement, as a sortable long."""
    return sortable(log_weight / F.lit(heat) - F.log(-F.log(uniform(ident, seed=seed))))


def threshold(light: DataFrame, part: float) -> int | None:
    """The k-th largest key of a table (key), k being this part of the rows, rounded up."""
    return kth_largest(light, "key", math.ceil(light.count() * part))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs that the sample takes, columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    model = fit(docs, labels, id_col, text_col)
    own = docs.toDF(*names)
    ident, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    key = gumbel_key(F.col("log_weight"), F.col(ident))
    light = stored(scored(own.select(ident, text), model, text).select(key.alias("key")), "weights")
    least = threshold(light, share(docs, labels, id_col))
    drop_stored(light)
    kept = scored(own, model, text).filter(key >= F.lit(least)) if least is not None else own.limit(0)
    return kept.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's log importance weight and whether the sample takes it."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = scored(docs, fit(docs, labels)).select("doc_id", "log_weight", gumbel_key(F.col("log_weight"), F.col("doc_id")).alias("key"))
    light = stored(weights, "weights")
    least = threshold(light, share(docs, labels))
    return light.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), (F.col("key") >= F.lit(least)).alias("kept") if least is not None else F.lit(False).alias("kept"))
