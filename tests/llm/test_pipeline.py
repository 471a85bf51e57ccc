"""The pipeline's stages, one after the other."""

import collections
import math
import struct

import numpy as np
import pytest
import xxhash

from tallyframe.llm import bpe, common, quality

from .test_operators import brute_links, mix_by_hand, quality_grams

pipeline = pytest.importorskip("corpus_pipeline")


def good_by_hand(spark, docs, labels, rows):
    """Ids that the classifier keeps."""
    model = quality.fit(docs, labels)  # held against counts by hand in test_operators
    known = {(r.doc_id, r.quality) for r in labels.collect() if r.quality is not None} & {(d, q) for d, _, _ in rows for q in (0, 1)}
    n, good = len(known), sum(q for _, q in known)
    z, p = quality.SIGMAS**2 / n, good / n
    k = math.ceil(len(rows) * min(1.0, (p + z / 2 + quality.SIGMAS * math.sqrt(p * (1 - p) / n + z / (4 * n))) / (1 + z)))
    keys = {}
    for d, t, _ in rows:
        cells = quality_grams((t or "").encode())
        weight = sum(int(model[c]) for c in cells) / 65536 / math.sqrt(max(1, len(cells)))
        h = xxhash.xxh64_intdigest(struct.pack("<i", quality.SEED), xxhash.xxh64_intdigest(struct.pack("<q", d), 42))
        keys[d] = weight / quality.HEAT - math.log(-math.log(((h >> 11) + 0.5) / (1 << 53)))
    least = sorted(keys.values(), reverse=True)[k - 1]
    return {d for d, key in keys.items() if key >= least - 1e-6}


def test_each_stage_by_brute_force(spark, sf_dir):
    """What run() does, stage by stage, each on what the stage before kept."""
    tokenizers = pytest.importorskip("tokenizers")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        rows = [(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()]
        out = pipeline.stored(stage(spark, docs, sf_dir), "test")
        got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        if k == 0:
            want = good_by_hand(spark, docs, labels, rows)
        elif k == 1:
            want = {max(d for d, u, _ in rows if (u or "") == t) for t in {t or "" for _, t, _ in rows}}
        elif k == 2:
            want = {d for d, _, low in brute_links([r[:2] for r in rows]) if d == low}
        elif k == 3:
            taken = mix_by_hand(rows, 64, 1 << 20)
            want = {d: c for d, t, _ in rows if (c := math.floor(taken[d] / max(1, len((t or "").encode().split())) + 0.5))}
        else:
            tokenizer = tokenizers.Tokenizer.from_file(bpe.vocabulary())
            ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t, _ in rows}
            assert all(r.ids == ids[r.doc_id] and r.n_tokens == len(r.ids) and r.decodes for r in out.collect())
            want = collections.Counter(d for d, _, _ in rows)
        assert got == collections.Counter(want), name
        assert k == 4 or out.columns == columns
        docs = out
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decodes"]


def test_each_stage_takes_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y", "en", None, 3), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3), (4, "a " * 40_000, "en", "s", 80_000), (5, "plain words here " * 100_000, "en", "t", 1_700_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", common.F.lit(1)).withColumn("node", common.F.lit("n"))
    # the classifier keeps its share; copies: null is empty, the largest id stays; one of each group of near copies and each row without a group; the mix takes no empty text
    least = [6, 4, 6, 1, 7]
    for (name, stage), n in zip(pipeline.STAGES, least, strict=True):
        out = stage(spark, docs, sf_dir)
        assert out.count() >= n, name
        assert name == pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    copies = {r.doc_id for r in pipeline.drop_copies(spark, docs, sf_dir).collect()}
    assert copies == {2, 3, 4, 5}
    assert not {1, 2} & {r.doc_id for r in pipeline.mix(spark, docs, sf_dir).collect()}


def test_run_agrees_with_itself(spark, sf_dir):
    a, b = (sorted((r.doc_id, r.n_tokens) for r in pipeline.run(spark, sf_dir).collect()) for _ in range(2))
    assert a == b and len(a) > 100


def test_models_are_whole_numbers(spark, sf_dir):
    """The same model however the rows are dealt out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    assert np.array_equal(quality.fit(docs, labels), quality.fit(docs.repartition(7), labels))
