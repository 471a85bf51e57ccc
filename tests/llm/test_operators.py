"""Each operator on small tables: brute force, odd rows, empty tables, clashing columns."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tallyframe.llm import avi, bpe, common, components, dedup, jaccard, licenses, linkgraph, mixing, pii, quality, tokencount

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, **more):
    """rows: (doc_id, text[, source]); with extra columns whose names the operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.withColumns({"id": F.lit("x"), "digest": F.lit(1), "size": F.lit("y"), "rid": F.lit(None).cast("string"), "count": F.lit(2), "node": F.lit(0), "label": F.lit("z"), "key": F.lit(1.5)} if more.get("clash") else {})


def words(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "é漢😀 naïve"), (6, "x" * 30_000), (7, "<|endoftext|> a"), (8, "same"), (9, "same"), (9, "same"), (None, "no id")]


# 1 ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bpe.vocabulary())


def test_bpe_equals_library(tokenizer):
    r = random.Random(1)
    texts = [t or "" for _, t in ODD] + ["".join(r.choice("ab  \n'<|>é漢😀0!tThe") for _ in range(r.randrange(300))) for _ in range(200)] + ["a" * 3000, " " * 999, "ab" * 700]
    own = bpe.Bpe(bpe.vocabulary())
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]
        assert own.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False) == text


def test_bpe_merges_leftmost_lowest_rank():
    """The forest against merging by hand, pair by pair."""
    own, r = bpe.Bpe(bpe.vocabulary()), random.Random(2)
    ranks = dict(zip(own.pairs.tolist(), own.ranks.tolist(), strict=True))

    def by_hand(word):
        ids = own.first[np.frombuffer(word, np.uint8)].tolist()
        while True:
            found = [(ranks[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (a << 20 | b) in ranks]
            if not found:
                return ids
            rank, i = min(found)
            ids[i : i + 2] = [int(own.merged[rank])]

    made = [bytes(r.choice(b"aethion s") for _ in range(r.randrange(1, 70))) for _ in range(300)]
    assert [x.tolist() for x in own.encode_words(made)] == [by_hand(w) for w in made]


def test_bpe_merges_whatever_the_leaves():
    """As many leaves as a pre-token of over 4 MiB has."""
    own, word = bpe.Bpe(bpe.vocabulary()), b" the same thing"
    few, many = (own._forest([word], leaves)[0].tolist() for leaves in (1 << 4, 1 << 23))
    assert many == few and len(few) < len(word)
    assert len(own.ranks) <= bpe.NONE and int(own.ranks.max()) < bpe.NONE


def test_bpe_rows(spark, tokenizer):
    rows = bpe.digest_rows(documents(spark, ODD, clash=True), bpe.vocabulary()).collect()
    assert len(rows) == len(ODD)
    want = collections.Counter()
    for i, t in ODD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in rows) == want
    assert bpe.digest_rows(documents(spark, []), bpe.vocabulary()).count() == 0
    arrays = bpe.encode_column(documents(spark, ODD, clash=True), bpe.vocabulary())
    assert arrays.columns[-1] == "ids" and arrays.filter("doc_id = 8").first()["ids"] == tokenizer.encode("same", add_special_tokens=False).ids
    assert bpe.token_rows(documents(spark, ODD), bpe.vocabulary()).filter("not decodes").count() == 0


# 2 ----------------------------------------------------------------------------------------------------------------
def test_mixing_reaches_targets(spark):
    rows = [(i, " ".join(words(i, 40 + i % 90)), f"s{i % 5}") for i in range(300)] + [(1000, None, "s0"), (1001, "", None), (1002, "a b c", None), (1002, "a b c", None), (None, "d e", "tiny")]
    out = mixing.mixed(common.stored(mixing.sized(documents(spark, rows, clash=True)), "t")).collect()
    assert len(out) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in out)
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    source = collections.defaultdict(set)
    for i, t, s in rows:
        source[i].add(s)
        by[s][0] += len((t or "").split())
    for r in out:
        (s,) = source[r.doc_id]
        by[s][1] += r.taken
        by[s][2] = r.target
        assert r.source_size == by[s][0]
    want = waterfill({s: v[0] for s, v in by.items()})
    for s, (size, taken, target) in by.items():
        assert target == pytest.approx(want[s])
        assert abs(taken - target) <= mixing.BLOCK / 2 + 1, (s, size)
    again = mixing.mixed(common.stored(mixing.sized(documents(spark, rows)), "t")).collect()
    assert collections.Counter((r.doc_id, r.taken) for r in out) == collections.Counter((r.doc_id, r.taken) for r in again)


def waterfill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        target = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if target[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **target}
        capped |= {s: 3 * sizes[s] for s in over}


def mix_by_hand(rows, block, most_blocks):
    """{(doc_id, size): taken} of rows (doc_id, text, source): streams, blocks and slots one by one. Documents have different ids."""
    import struct
    from fractions import Fraction

    import xxhash

    place = lambda i: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(struct.pack("<i", mixing.SEED), xxhash.xxh64_intdigest(struct.pack("<q", i), 42)))
    streams = collections.defaultdict(list)
    for i, t, s in rows:
        streams["n" if s is None else "s" + s].append((place(i) % mixing.LEAST_BUCKETS, place(i), i, len((t or "").split())))
    sizes = {k: sum(x[-1] for x in v) for k, v in streams.items()}
    want = waterfill({None if k == "n" else k[1:]: v for k, v in sizes.items()})
    starts, quota = {}, {}
    for k, size in sizes.items():
        n = -(-size // max(block, size // most_blocks))
        cuts = [0]
        for b in range(n):
            cuts.append(cuts[-1] + size // n + (b < size % n))
        starts[k] = cuts
        words = lambda q, n=n, cuts=cuts: q // n * cuts[-1] + cuts[q % n] if n else 0
        target = want[None if k == "n" else k[1:]]
        quota[k] = min(range(3 * n + 1), key=lambda q: (abs(words(q) - target), q))
    total, taken, at = sum(quota.values()), collections.Counter(), {}
    bounds, before = {}, 0
    for k in sorted(quota):
        bounds[k] = (round(Fraction(before << 62, total)), round(Fraction((before + quota[k]) << 62, total)))
        before += quota[k]
    ranks = collections.Counter()
    for slot in range(total):
        point = slot * mixing.GOLDEN % (1 << 62)
        (k,) = (k for k, (low, high) in bounds.items() if low <= point < high)
        ranks[k] += 1
    blocks = collections.Counter((k, r % (len(starts[k]) - 1)) for k, q in quota.items() for r in range(q))  # what discrepancy cuts off or adds
    assert all(abs(ranks[k] - q) <= 4 for k, q in quota.items())
    for k, docs in streams.items():
        at = 0
        for _, _, i, size in sorted(docs):
            for b, times in ((b, t) for (key, b), t in blocks.items() if key == k):
                taken[i] += times * max(0, min(at + size, starts[k][b + 1]) - max(at, starts[k][b]))
            at += size
    return taken


@pytest.mark.parametrize(("block", "most_blocks"), [(64, 1 << 20), (16, 50)])
def test_mixing_by_hand(spark, block, most_blocks):
    rows = [(i, " ".join(words(i, 20 + i * 37 % 150)), None if i % 7 == 6 else f"s{i % 7}") for i in range(120)] + [(500, None, "s0"), (501, "x " * 3000, "s1"), (502, "a", "tiny")]
    light = common.stored(mixing.sized(documents(spark, rows, clash=True)), "t")
    sizes = light.groupBy("skey").agg(F.sum("size").alias("source_size"))
    quota = mixing.quotas(mixing.targets(sizes), block, most_blocks)
    assert quota.agg(F.max("n_blocks")).first()[0] <= max(most_blocks + most_blocks // 2, 0) or block == 64
    got = {r.doc_id: r.taken for r in mixing.mixed(light, block, most_blocks).collect()}
    want = mix_by_hand(rows, block, most_blocks)
    assert got == {i: want[i] for i, _, _ in rows}


def test_points_stay_apart(spark):
    slots = [0, 1, 2, 5, 10**6, 10**9 + 7, (1 << 38) - 1, (1 << 40) - 1]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in slots], "s long").select(mixing.point_of(F.col("s"))).collect()]
    assert got == [s * mixing.GOLDEN % (1 << mixing.POINT_BITS) for s in slots] and mixing.GOLDEN == int((5**0.5 - 1) / 2 * 2**20) << 42 | mixing.GOLDEN & ((1 << 42) - 1)
    far = spark.range(1 << 38, (1 << 38) + 100_000).select(F.shiftright(mixing.point_of(F.col("id")), 62 - 30).alias("p"))
    assert far.distinct().count() == 100_000


def test_mixing_documents(spark):
    rows = [(i, " ".join(words(i, 50)), f"s{i % 3}") for i in range(90)]
    docs = documents(spark, rows, clash=True)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    taken = collections.Counter(r.source for r in out.select("source").collect())
    assert taken["s0"] > 1.8 * taken["s1"] > 2.5 * taken["s2"]
    assert mixing.mix_documents(documents(spark, [])).count() == 0


# 3 ----------------------------------------------------------------------------------------------------------------
def quality_grams(text):
    """Cells of the grams of a text, by hand."""
    import math

    tokens = [m[0] for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+", text)]
    odd, whole = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def hashed(token):
        h = sum((b + 1) * int(quality._PLACE[i & 63]) for i, b in enumerate(token)) & whole
        return (h ^ (h >> 31)) * odd & whole

    def recency(values):
        last, before, out = {}, 0, []
        for i, v in enumerate(values):
            gap = i - last.get(v, i)
            last[v] = i
            out.append(min(math.frexp(gap)[1], 15) << 1 | (i > 0 and gap > 0 and gap == before))
            before = gap
        return out

    one = [hashed(t) for t in tokens]
    two = [(v := (a * 3 + b) & whole) ^ (v >> 29) for a, b in zip(one, one[1:], strict=False)]
    cells = [(v * odd & whole) >> (64 - quality.CELL_BITS) for v in one] + [((v * odd & whole) >> (64 - quality.CELL_BITS)) + quality.KINDS[1][0] for v in two]
    return cells + [quality.KINDS[2][0] + g for g in recency(one)] + [quality.KINDS[3][0] + g for g in recency(two)]


QUALITY_TEXTS = [b"Plain words, and more. ", b"", b" \n ", b"A!! B!! A!!", b"no no no no", "é è".encode() * 30, b"a b a b a b c", b"one", b"&&&", b"a b c d a b c d"]


def test_quality_weights_by_hand():
    import math

    import pyarrow as pa

    model = np.random.default_rng(1).integers(-100_000, 100_000, quality.CELLS)
    by_hand = lambda t: sum(int(model[c]) for c in quality_grams(t)) / 65536 / math.sqrt(max(1, len(quality_grams(t))))
    assert quality.log_weights(pa.array([*QUALITY_TEXTS, None], pa.binary()), model).tolist() == pytest.approx([*map(by_hand, QUALITY_TEXTS), 0])
    long = b"words of a long text, " * 100_000
    pieces = [quality_grams(long[k : k + quality.PIECE]) for k in range(0, len(long), quality.PIECE)]
    want = sum(int(model[c]) for p in pieces for c in p) / 65536 / math.sqrt(sum(map(len, pieces)))
    assert quality.log_weights(pa.array([b"a", long, b"b"], pa.binary()), model)[1] == pytest.approx(want)


def test_quality_fit_by_hand(spark):
    """Both models counted by hand."""
    import math

    rows = [(i, t.decode() or None) for i, t in enumerate(QUALITY_TEXTS)]
    good = {0, 3, 6, 9}
    labels = spark.createDataFrame([(i, 1) for i in sorted(good)] + [(4, 0), (3, 1), (999, 1), (None, 1)], "doc_id long, quality int")
    model = quality.fit(documents(spark, rows), labels)
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        cells = quality_grams((t or "").encode())
        raw.update(cells)
        target.update(cells if i in good else ())
    for a, b in quality.KINDS:
        all_raw, all_target, n = sum(v for c, v in raw.items() if a <= c < b), sum(v for c, v in target.items() if a <= c < b), b - a
        for c in (c for c in raw if a <= c < b):
            q = (raw[c] + quality.SMOOTH * all_raw / n) / (all_raw * (1 + quality.SMOOTH))
            assert model[c] == round(math.log((target[c] + quality.PRIOR * n * q) / (all_target + quality.PRIOR * n) / q) * 65536)
    assert quality.share(documents(spark, rows), labels, sigmas=0) == pytest.approx(4 / 5)


def test_gumbel_top_k_draws_by_weight(spark):
    """Inclusion frequencies over many seeds against those of drawing one by one without replacement."""
    import itertools

    weights, k, seeds = [0.1, 0.5, 1.0, 2.0, 6.0], 2, 4000
    want = [0.0] * len(weights)
    for drawn in itertools.permutations(range(len(weights)), k):
        p, left = 1.0, sum(weights)
        for i in drawn:
            p, left = p * weights[i] / left, left - weights[i]
        for i in drawn:
            want[i] += p
    seeded = spark.range(seeds).select(F.col("id").alias("seed"), F.explode(F.array(*(F.struct(F.lit(i).alias("item"), F.lit(float(np.log(w)) * quality.HEAT).alias("w")) for i, w in enumerate(weights)))).alias("x")).select("seed", "x.item", "x.w")
    from pyspark.sql import Window

    ranked = seeded.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc(quality.gumbel_key(F.col("w"), F.struct("seed", "item"))))))
    got = {r["item"]: r["n"] / seeds for r in ranked.filter(F.col("rank") <= k).groupBy("item").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(got[i] - want[i]) < 4 * (want[i] * (1 - want[i]) / seeds) ** 0.5 + 0.005 for i in range(len(weights))), (got, want)


def test_quality_held_out(spark):
    """Fit on half of the labels, judged on the other half; and the sample is no threshold on the weight."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    light = common.stored(quality.scored(docs.select("doc_id", "text", "lang"), quality.fit(docs, labels, which=half)).select("doc_id", "lang", "log_weight", quality.gumbel_key(F.col("log_weight"), F.col("doc_id")).alias("key")), "t")
    least = quality.threshold(light, quality.share(docs, labels, which=half))
    out = light.join(labels.filter(~half), "doc_id").select("quality", "lang", (F.col("key") >= least).cast("int").alias("kept")).collect()
    good, bad = [r.kept for r in out if r.quality == 1], [r.kept for r in out if r.quality == 0]
    assert sum(good) / len(good) > 0.985 and sum(bad) / len(bad) < 0.15
    for lang in ("en", "fr", "de", "es"):
        own = [r.kept for r in out if r.quality == 1 and r.lang == lang]
        assert sum(own) / len(own) > 0.95, lang
    # by weight alone, with the same k
    rows = light.select("log_weight", (F.col("key") >= least).alias("kept")).collect()
    assert max(r.log_weight for r in rows if not r.kept) > min(r.log_weight for r in rows if r.kept)


def test_quality_odd_rows(spark):
    rows = ODD + [(100 + i, "A plain sentence that says a thing. " * (1 + i % 4)) for i in range(400)] + [(600 + i, "BUY!! NOW!! " * 200) for i in range(100)] + [(900, "A plain sentence that says a thing. " * 60_000)]
    labels = spark.createDataFrame([(100 + i, 1) for i in range(390)] + [(600 + i, 0) for i in range(100)] + [(None, 1), (101, 1), (201, None), (9999, 1)], "doc_id long, quality int")
    docs = documents(spark, rows, clash=True)
    out = quality.keep_good(docs, labels)
    kept = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    junk = sum(kept[600 + i] for i in range(100))
    assert out.columns == docs.columns and sum(kept[100 + i] for i in range(400)) > 390 and kept[1] and kept[2]
    assert junk <= out.count() - sum(kept[100 + i] for i in range(400)) and junk < 50
    assert quality.keep_good(documents(spark, []), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == len(rows)


# 4 ----------------------------------------------------------------------------------------------------------------
def test_license_cues_lose_nothing():
    """Of each template so many shingles hold a cue that those without are under 0.75 of it."""
    for _, notice in licenses.TEMPLATES:
        w = re.sub("[^a-z0-9]+", " ", notice.lower()).split()
        shingles = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert not shingles and len(w) < 5 or sum(not set(s) & set(licenses.CUES) for s in shingles) < licenses.LEAST * len(shingles), notice


def test_license_matches(spark):
    filler = " ".join(words(3, 500))
    rows = ODD + [(20, f"{filler}\nReleased under the MIT License.\n{filler}"), (21, "This work is licensed under the GNU General Public License, version 3."), (22, "Licensed under CC BY-NC 4.0."), (23, "a license to say nothing at all here"), (24, "This work is licensed under the GNU General Public License, version 2.")]
    found = {(r.doc_id, r.license): r for r in licenses.matches(documents(spark, rows, clash=True)).collect()}
    assert set(found) == {(20, "mit"), (21, "gpl-3.0"), (22, "cc-by-nc-4.0"), (24, "gpl-2.0")}
    assert found[21, "gpl-3.0"].containment == found[24, "gpl-2.0"].containment == 1
    assert licenses.matches(documents(spark, [])).count() == 0


def test_every_template_is_found(spark):
    """In long texts, whole and with a word in twelve changed; and nothing else but what shares its words."""
    r, rows = random.Random(5), []
    for k, (_, notice) in enumerate(licenses.TEMPLATES):
        w = notice.split()
        bent = [f"q{r.randrange(999)}" if i % 25 == 24 else x for i, x in enumerate(w)]
        rows += [(k, " ".join(words(k, 700)) + f"\n{notice}\n" + " ".join(words(k + 1, 700))), (100 + k, " ".join(words(k, 333) + bent + words(k, 50)))]
    rows.append((999, " ".join(words(1, 300) + ["license", "software"] * 3) * 500 + " " + licenses.TEMPLATES[-1][1]))  # long, full of cues
    found = {(x.doc_id, x.license) for x in licenses.matches(documents(spark, rows, clash=True)).collect()}
    for k, (name, notice) in enumerate(licenses.TEMPLATES):
        assert (k, name) in found and (100 + k, name) in found, notice
    assert {n for d, n in found if d == 999} == {"zlib"}
    families = {(n.split("-")[0], licenses.TEMPLATES[d % 100][0].split("-")[0]) for d, n in found if d < 999}
    assert {f for f in families if f[0] != f[1]} == set()


def test_license_sql(spark):
    """The query's SQL against matches() on texts with notices at all places, versions and short notices."""
    duckdb = pytest.importorskip("duckdb")
    r, rows = random.Random(6), list(ODD)
    for k in range(150):
        parts = [" ".join(words(r.randrange(99), r.randrange(40)))] + [r.choice(licenses.TEMPLATES)[1].replace("3", r.choice("234")).rsplit(" ", r.randrange(4))[0] + " " + " ".join(words(r.randrange(99), r.randrange(9))) for _ in range(r.randrange(3))]
        rows.append((2000 + k, " ".join(parts)))
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(i, t) for i, t in rows])
    want = sorted(map(tuple, con.execute(licenses.OP4_SQL).fetchall()))
    got = sorted((x.doc_id, x.license, round(x.containment, 6), x.first_word) for x in licenses.matches(documents(spark, rows)).collect())
    assert got == want and len(want) > 60


def test_short_license_notices_are_sought_whole(spark):
    """Notices of fewer words than a shingle."""
    rows = ODD + [(30, "(c) 2020 A. Body.\nAll  rights\nRESERVED."), (31, "all rights are reserved, small rights reserved"), (32, "All rights reserved. Released under the MIT License. All rights reserved."), (33, "ISC")]
    templates = (*(x for x in licenses.TEMPLATES if x[0] != "all-rights-reserved"), ("proprietary", "All rights reserved."), ("isc", "ISC"))
    found = {(r.doc_id, r.license, r.containment, r.first_word) for r in licenses.matches(documents(spark, rows, clash=True), templates=templates).collect()}
    assert found == {(30, "proprietary", 1.0, 4), (32, "proprietary", 1.0, 0), (32, "mit", 1.0, 2), (33, "isc", 1.0, 0)}
    only = licenses.matches(documents(spark, rows), templates=templates[-2:-1]).collect()
    assert {r.doc_id for r in only} == {30, 32}


# 5 ----------------------------------------------------------------------------------------------------------------
def one(spark, text, key=pii.KEY):
    return spark.createDataFrame([(text,)], "text string").select(pii.pseudonymised(F.col("text"), key)).first()[0]


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_keep_formats(spark):
    out = one(spark, "card 4111 1111 1111 1111, again 4111111111111111; call +1 (223) 555-1234 or 223-555-1234; ip 10.0.0.1. ssn 123-45-6789 on 2024-02-29, 12/31/1999; mail bob@x.org")
    card = re.search(r"card ((?:\d{4} ){3}\d{4})", out)[1]
    assert luhn(card.replace(" ", "")) and card.replace(" ", "") in out.split("again ")[1] and "4111" not in out
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", out).groups()
    assert "-".join(phone) in out and phone[0] >= "200" and "555-1234" not in out
    assert all(int(x) < 256 for x in re.search(r"ip (\d+\.\d+\.\d+\.\d+)\. ssn", out)[1].split(".")) and "10.0.0.1" not in out
    assert re.search(r"ssn \d{3}-\d{2}-\d{4} on \d{4}-\d{2}-\d{2}, \d{2}/\d{2}/\d{4}; mail u[0-9a-f]{12}@x\.org", out)


def test_pseudonyms_leave_the_rest(spark):
    for text in (None, "", "no number", "4111111111111112", "300.1.1.1", "1.2.3.4.5", "000-12-3456", "2023-02-29", "v 2.0.", "é漢 12"):
        assert one(spark, text) == text
    assert one(spark, "10.0.0.1") != one(spark, "10.0.0.1", "another key")
    docs = documents(spark, [(1, "10.0.0.1 x"), (2, None)], clash=True)
    assert pii.with_pseudonyms(docs).columns == docs.columns and pii.with_pseudonyms(documents(spark, [])).count() == 0


@pytest.mark.parametrize(("a", "b"), [(7, 13), (64, 10), (1, 50)])
def test_feistel_is_a_bijection(spark, a, b):
    pairs = spark.range(a * b).select(pii.feistel(F.floor(F.col("id") / b), F.col("id") % b, F.lit(a), F.lit(b), "k", "t").alias("y"))
    assert {(r.y.l, r.y.r) for r in pairs.collect()} == {(i, j) for i in range(a) for j in range(b)}


@pytest.mark.parametrize(
    "value",
    ["1-800-555-0199", "1 800-555-0199", "+1-555-123-4567", "+15551234567", "+1 555 123 4567", "1 (555) 555-1234", "(555)555-1234", "555.123.4567", "555 123-4567", "415 555 1234", "+44 20 7946 0958", "+44 (0)20 7946 0958", "+33 1 23 45 67 89", "+4915112345678"]
    + ["3782 822463 10005", "3782-822463-10005", "378282246310005", "3056 930902 5904", "2024/02/29", "29.02.2024", "2024.02.29", "29-02-2024", "12-31-1999"],
)
def test_other_spellings_get_pseudonyms(spark, value):
    before, out, after = re.fullmatch(r"(call )(.*)(\. Then 7 of 12)", one(spark, f"call {value}. Then 7 of 12")).groups()
    assert out != value and re.sub("[0-9]", "0", out) == re.sub("[0-9]", "0", value)
    plus = re.match(r"\+(1|44|33|49)|1(?=[ -])", value)
    assert not plus or out.startswith(plus[0])
    if value.startswith("3") and "." not in value:
        assert luhn(re.sub("[^0-9]", "", out))


def test_spellings_of_a_value_share_its_pseudonym(spark):
    for values in (["+1 (555) 123-4567", "1-555-123-4567", "555.123.4567", "(555)123-4567", "+15551234567"], ["+44 20 7946 0958", "+442079460958"], ["2024-02-27", "2024/02/27", "2024.02.27"], ["27.02.2024", "27.02.2024"]):
        assert len({re.sub("[^0-9]", "", one(spark, v))[-10:] for v in values}) == 1
    rows = spark.range(3000).select(F.concat(F.lit("+49 30 "), F.lpad((F.col("id") * 7).cast("string"), 6, "0")).alias("t"))
    assert rows.select(pii.pseudonymised(F.col("t")).alias("p")).distinct().count() == 3000


def test_other_numbers_stay(spark):
    for text in ("1.5551234567", "100 200 3000", "5551234567", "+1 555 1234", "+12", "3782 822463 10006", "30.02.2024", "1.2.2024", "12.03.2024.1", "5.555.123.4567", "2.5+2=4"):
        assert one(spark, text) == text


def test_phone_pseudonyms_are_different(spark):
    rows = spark.range(3000).select(F.concat(F.lpad((F.col("id") % 999).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.col("id") * 7 % 999).cast("string"), 3, "0"), F.lit("-0001")).alias("t")).distinct()
    assert rows.select(pii.pseudonymised(F.col("t")).alias("p")).distinct().count() == rows.count()


def pseudonymised_by_hand(text, key=pii.KEY):
    """The whole operator in Python: values one by one, with the same patterns."""
    import datetime

    if text is None:
        return None

    def feistel(left, right, a, b, kind):
        for n in range(1, pii.ROUNDS + 1):
            half = right if n % 2 else left
            add = int(hashlib.sha256(f"{key}|{kind}|{n}|{half}|{a}|{b}".encode()).hexdigest()[:15], 16)
            left, right = ((left + add) % a, right) if n % 2 else (left, (right + add) % b)
        return left, right

    def filled(m, digits):
        left = iter(digits)
        return "".join(next(left) if c.isdigit() else c for c in m)

    def halves(digits, kind):
        high = len(digits) - len(digits) // 2
        y = feistel(int(digits[:high]), int(digits[high:]), 10**high, 10 ** (len(digits) - high), kind)
        return str(y[0]).zfill(high) + str(y[1]).zfill(len(digits) - high)

    def mail(m):
        return "u" + hashlib.sha256(f"{key}|mail|{m.lower()}".encode()).hexdigest()[:12] + m[m.rindex("@") :]

    def ip(m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255 or any(len(x) > 1 and x[0] == "0" for x in m.split(".")):
            return m
        y = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
        return ".".join(str(x) for h in y for x in divmod(h, 256))

    def phone(m):
        d = re.sub("[^0-9]", "", m)
        if re.match(r"\+[2-9]", m):
            code = re.match(pii.COUNTRY, d)[0]
            return filled(m, code + halves(d[len(code) :], "phone"))
        own = d[-10:]
        area, office, line = int(own[:3]), int(own[3:6]), int(own[6:])
        if area >= 200 and office >= 200:
            x, y = feistel((area - 200) * 800 + office - 200, line, 640_000, 10_000, "phone")
            upper = (x // 800 + 200) * 1000 + x % 800 + 200
        else:
            x, y = feistel(area * 1000 + office if area < 200 else 200_000 + (area - 200) * 200 + office, line, 360_000, 10_000, "phone")
            upper = x if x < 200_000 else ((x - 200_000) // 200 + 200) * 1000 + (x - 200_000) % 200
        return filled(m, d[:-10] + str(upper).zfill(6) + str(y).zfill(4))

    def date(m):
        d = re.sub("[^0-9]", "", m)

        def parsed(form):
            try:
                return datetime.datetime.strptime(d, form).date()
            except ValueError:
                return None

        first = datetime.date(1900, 1, 1)
        usual, turned = ("%Y%m%d", None) if not m[4].isdigit() else ("%d%m%Y", "%m%d%Y") if "." in m else ("%m%d%Y", "%d%m%Y")
        if day := parsed(usual):
            at, (a, b), form = (day - first).days, pii.DAYS, usual
            days = lambda y: first + datetime.timedelta(y)
            kind = "date"
        elif turned and (day := parsed(turned)):
            at, (a, b), form = (day - first).days - 12 * ((day.year - 1900) * 12 + day.month), pii.LATE_DAYS, turned
            days, kind = lambda y: late_days()[y], "late day"
        else:
            return m
        if not 0 <= at < a * b:
            return m
        y = feistel(at // b, at % b, a, b, kind)
        new = days(y[0] * b + y[1])
        return filled(m, new.strftime(form).zfill(8))

    def ssn(m):
        area, group, serial = map(int, m.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return m
        x, y = feistel((area - 2 if area > 666 else area - 1) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
        at = x // 99
        return f"{at + 2 if at >= 665 else at + 1:03}-{x % 99 + 1:02}-{y + 1:04}"

    def card(m):
        d = re.sub("[ -]", "", m)
        if not luhn(d):
            return m
        n = len(d) - 1
        low = n // 2
        x, y = feistel(int(d[: n - low]), int(d[n - low : n]), 10 ** (n - low), 10**low, "card")
        body = str(x).zfill(n - low) + str(y).zfill(low)
        return filled(m, body + next(c for c in "0123456789" if luhn(body + c)))

    made = {"mail": mail, "ip": ip, "phone": phone, "date": date, "ssn": ssn, "card": card}
    kinds = [(regex.compile(pattern, regex.ASCII), made[name]) for name, pattern, _ in pii.KINDS]
    return regex.sub(pii.FOUND, lambda m: next(f(m[0]) for pattern, f in kinds if pattern.fullmatch(m[0])), text, flags=regex.ASCII)


def late_days(known=[]):  # noqa: B006
    import datetime

    if not known:
        known += [day for n in range(pii.DAYS[0] * pii.DAYS[1]) if (day := datetime.date(1900, 1, 1) + datetime.timedelta(n)).day > 12]
    return known


def test_pseudonyms_by_hand(spark, sf_dir):
    """Odd, adversarial and long texts, all formats, and whole test documents."""
    r = random.Random(8)
    digits = lambda form: "".join(str(r.randrange(10)) if c == "#" else c for c in form)
    forms = ["+1 (###) ###-####", "###-###-####", "(###) ###-####", "### ### ####", "+44 20 #### ####", "#.#.#.#", "1#.2#.###.#", "010.1.1.#", "20##-0#-1#", "19##/1#/0#", "0#/1#/19##", "1#/0#/20##", "2#/0#/19##", "31/12/20##", "0#.1#.20##", "1#.2#.19##", "###-##-####", "#### #### #### ####", "################", "3### ###### #####", "a.b@c#.org", "X_#@y.co.uk"]
    values = " ; ".join(digits(f) for _ in range(60) for f in forms)
    rows = ODD + [(20, values), (21, "x@" + "a." * 500_000 + "com"), (22, "x@a..b x@a.b. @ a@b"), (23, "1" * 300_000), (24, "1-" * 200_000 + " 4111 1111 1111 1111"), (25, "word 10.0.0.1 " * 30_000), (26, "a" * 2_000_000 + "@x.org"), (27, "4111111111111111"), (27, "4111111111111111")]
    docs = documents(spark, rows, clash=True)
    out = pii.with_pseudonyms(docs)
    assert out.columns == docs.columns
    want = collections.Counter((i, pseudonymised_by_hand(t)) for i, t in rows)
    got = collections.Counter((x.doc_id, x.text) for x in out.select("doc_id", "text").collect())
    assert got == want
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert {x.doc_id: x.text for x in pii.with_pseudonyms(whole).collect()} == {x.doc_id: pseudonymised_by_hand(x.text) for x in whole.collect()}


@pytest.mark.parametrize("form", ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "MM.dd.yyyy", "MM-dd-yyyy"])
def test_day_pseudonyms_are_different(spark, form):
    """All days of 1985 to 2014 together with those of the other order."""
    other = form.replace("MM", "xx").replace("dd", "MM").replace("xx", "dd") if not form.startswith("yyyy") else form
    days = spark.range(30 * 365).select(F.date_add(F.lit("1985-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    texts = days.select(F.explode(F.array(F.date_format("d", form), F.date_format("d", other))).alias("t")).distinct()
    out = texts.select("t", pii.pseudonymised(F.col("t")).alias("p")).cache()
    assert out.select("p").distinct().count() == out.count() and out.filter("length(p) <> length(t)").isEmpty()
    out.unpersist()


# 6 ----------------------------------------------------------------------------------------------------------------
def best_segmentation(score, word):
    """Pieces of the best segmentation: all last pieces of all prefixes."""
    best = [0] + [None] * len(word)
    for i in range(1, len(word) + 1):
        best[i] = max(best[j] + score[word[j:i]] for j in range(max(0, i - 130), i) if word[j:i] in score)
    return -best[-1] % tokencount.PIECE


def test_token_counts_are_the_best_segmentation():
    r = random.Random(4)
    counter = tokencount.Counter(bpe.vocabulary(), np.array([r.randrange(1000) for _ in range(50257)]))
    score = counter.model.score
    made = [bytes(r.choice(b"aethion sXY9") for _ in range(r.randrange(1, 40))) for _ in range(300)]
    want = [best_segmentation(score, w) for w in made]
    assert [counter.trie.insert(w) for w in made] == want and [counter.trie.alone(w) for w in made] == want
    texts = [None, "", "the the  them", "é" * 500, "ab" * 2000, "ab" * 2000 + " ab"]
    assert list(counter.counts(texts)) == [(sum(best_segmentation(score, p.encode()) for p in counter.split(t or "")), len(counter.split(t or ""))) for t in texts]
    nodes = len(counter.trie.forward)
    assert list(counter.counts(["x" * 1_000_000]))[0][1] == 1 and len(counter.trie.forward) == nodes


def test_token_tries_take_many_words_at_once(monkeypatch):
    """Words of all lengths in one trie, in half the time of one after the other; what is met again and again is inserted once."""
    r = random.Random(6)
    counter = tokencount.Counter(bpe.vocabulary(), np.array([r.randrange(1000) for _ in range(50257)]))
    made = [b"", b"\0", b"a\0\0", b" " * 120, *(bytes(r.choice(b"aethion sXY9\0\xc3\xa9") for _ in range(r.randrange(1, 30))) for _ in range(40_000))]
    before = time.process_time()
    want = [counter.trie.alone(w) for w in made]
    between = time.process_time()
    assert counter.trie.insert_all(made) == want and 2 * (time.process_time() - between) < between - before
    assert counter.trie.insert_all([bytes(range(256)) * 2]) == [best_segmentation(counter.model.score, bytes(range(256)) * 2)]
    assert want[-50:] == [best_segmentation(counter.model.score, w) for w in made[-50:]] and counter.trie.insert_all([]) == []
    monkeypatch.setattr(tokencount, "KEEP", 100)
    monkeypatch.setattr(tokencount, "WORK", 400)
    seen, insert_all = collections.Counter(), counter.trie.insert_all
    monkeypatch.setattr(counter.trie, "insert_all", lambda words: (seen.update(words), insert_all(words))[1])
    texts = ["the same" + "".join(f" {r.choice('abcde')}{r.randrange(10**6):x}" for _ in range(20)) for _ in range(300)]
    assert [n for n, _ in counter.counts(texts)] == [sum(best_segmentation(counter.model.score, p.encode()) for p in counter.split(t)) for t in texts]
    assert seen[b"the"] == seen[b" same"] == 1 and len(counter.known) + len(counter.older) < 400


def test_fast_split_is_that_of_regex():
    import public_tokenizers

    r, pattern = random.Random(7), public_tokenizers.PATTERN
    every = [chr(c) for c in range(1 << 16)]
    texts = [f"{a}{b}  {a}'s{b}1" for a, b in zip(every, r.sample(every, len(every)), strict=True)]
    texts += ["".join(r.choices(["a", "é", "ß", "1", "²", " ", "\n", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "'s", "'ll", "'", "_", "漢", "😀", "𝐀", "𝟏"], k=30)) for _ in range(3000)]
    for p in (pattern, r" ?\p{L}+|\d+|\s+", r"(?i)'s|\p{N}|[\S]"):
        split, want = tokencount.splitter(p), regex.compile(p).findall
        assert all(split(t) == want(t) for t in texts)


def test_token_count_rows(spark, tokenizer):
    """Model and counts by hand."""
    import math

    rows = [*ODD, (12, "the words of a long text " * 40_000)]
    got = tokencount.token_counts(documents(spark, rows, clash=True), bpe.vocabulary()).collect()
    seen = collections.Counter()
    for i, t in rows:
        if i is not None:
            seen.update(tokenizer.encode(t or "", add_special_tokens=False).ids)
    pieces = {i: b for i, b in tokencount._spec(bpe.vocabulary()).items() if b}
    total = sum(seen[i] + tokencount.PRIOR for i in pieces)
    score = {b: round(math.log((seen[i] + tokencount.PRIOR) / total) * tokencount.UNIT) * tokencount.PIECE - 1 for i, b in pieces.items()}
    split, known = tokencount.Counter(bpe.vocabulary()).split, {}
    count = lambda t: sum(known.setdefault(p, None) or known.__setitem__(p, best_segmentation(score, p.encode())) or known[p] for p in split(t or ""))
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_pretokens) for r in got) == collections.Counter((i, count(t), len(split(t or ""))) for i, t in rows)
    assert tokencount.token_counts(documents(spark, []), bpe.vocabulary()).count() == 0


def test_token_model_is_of_all_documents(spark, tokenizer):
    """5,000 documents, special tokens and odd ones among them: pieces are counted as the tokenizer cuts all of them."""
    r = random.Random(8)
    words = ["the", "of", "l'été", "naïve", "12", "345", "\n\n", "  ", "it's", "!'s", "<|endoftext|>", "αβγ", "x" * 30]
    rows = [*ODD, *((100 + i, " ".join(r.choice(words) + r.choice(["", ".", " ", "\t"]) for _ in range(r.randrange(12))) + str(i)) for i in range(5000))]
    seen = collections.Counter()
    for i, t in rows:
        if i is not None:
            seen.update(tokenizer.encode(t or "", add_special_tokens=False).ids)
    special = {i for i, b in tokencount._spec(bpe.vocabulary()).items() if b is None}
    counts = tokencount.fit(documents(spark, rows), bpe.vocabulary())
    assert {i: int(n) for i, n in enumerate(counts) if n} == {i: n for i, n in seen.items() if i not in special}


# 7 ----------------------------------------------------------------------------------------------------------------
def brute_links(rows, counts=False):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(i)] = find(j)
    if counts:
        links = [sum(bool(x and y and i != j and 100 * len(x & y) >= 75 * len(x | y)) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return collections.Counter((d, len(x), d if not x else low.get(find(i)), *([links[i]] if counts else [])) for i, ((d, _), x) in enumerate(zip(rows, sets, strict=True)))


def near_rows():
    r, rows = random.Random(6), list(ODD)
    for g in range(12):
        base = words(100 + g, r.choice([5, 6, 9, 20, 60, 300, 1500]), 5000)
        for k in range(12):
            w = list(base)
            for _ in range(r.randrange(1 + len(w) // 25)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            rows.append((1000 + 100 * g + k, " ".join(w if k % 3 else w[: max(1, len(w) * 9 // 10)])))
    rows += [rows[20], rows[20], rows[45]]  # rows that repeat a document, among near copies
    passage = words(9, 60)
    rows += [(5000 + i, " ".join(words(7000 + i, 120, 5000) + passage)) for i in range(40)]
    return rows


def test_jaccard_equals_brute_force(spark):
    rows = near_rows()
    out = jaccard.connected(documents(spark, rows, clash=True)).collect()
    assert collections.Counter(tuple(r) for r in out) == brute_links(rows)
    counted = jaccard.connected(documents(spark, rows, clash=True), counts=True).collect()
    assert collections.Counter(tuple(r) for r in counted) == brute_links(rows, True)
    assert jaccard.connected(documents(spark, [])).count() == 0 and jaccard.connected(documents(spark, []), counts=True).count() == 0


@pytest.mark.parametrize(("tile", "held"), [(4, 1 << 19), (512, 300)])
def test_jaccard_tiles_split_groups(spark, monkeypatch, tile, held):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "HELD", held)
    rows = near_rows()
    assert collections.Counter(tuple(r) for r in jaccard.connected(documents(spark, rows), counts=True).collect()) == brute_links(rows, True)


def test_jaccard_exact_by_prefixes(spark):
    rows = near_rows()
    out = jaccard.connected(documents(spark, rows, clash=True), counts=True, exact=True).collect()
    assert collections.Counter(tuple(r) for r in out) == brute_links(rows, True)
    r = np.random.default_rng(9)
    for _ in range(500):
        n = int(r.integers(1, 300))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([r.permutation(x)[: int(len(x) * r.uniform(0.8, 1))], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.15)), dtype=np.uint64)]))
        assert not jaccard.linked(x, y) or np.intersect1d(jaccard.prefix_keys(x), jaccard.prefix_keys(y)).size


def test_jaccard_recall_at_the_threshold(spark):
    """Pairs of 0.75 to 0.8, 3,000 documents: every link is found."""
    r, rows, want = random.Random(12), [], set()
    for g in range(1500):
        n = r.choice([12, 30, 70, 150, 300])
        base = [f"v{r.randrange(10**9)}" for _ in range(n)]
        more = [f"v{r.randrange(10**9)}" for _ in range(max(1, round(n * r.uniform(0.25, 0.33))))]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base + more))]
        if 100 * (n - 4) >= 75 * (n + len(more) - 4):
            want.add(g)
    out = {x.doc_id: x.component_id for x in jaccard.connected(documents(spark, rows)).collect()}
    assert {g for g in range(1500) if out[2 * g + 1] == 2 * g} == want and len(want) > 700


def test_jaccard_long_near_copies(spark):
    """Texts of 300 KB, alike by hundreds of thousands of words."""
    base = words(77, 60_000, 10**6)
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(6)] + [(10, " ".join(words(78, 60_000, 10**6)))]
    out = {x.doc_id: (x.component_id, x.n_links) for x in jaccard.connected(documents(spark, rows), counts=True).collect()}
    assert out == {**dict.fromkeys(range(6), (0, 5)), 10: (10, 0)}


def test_jaccard_bound_never_rules_out_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        n = int(r.integers(4, 4000))
        x = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: int(len(x) * r.uniform(0.7, 1))], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.2)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        assert jaccard.linked(x, y) == (100 * both >= 75 * (len(x) + len(y) - both))
        bits = [np.frombuffer(jaccard.bitmap(s), np.uint64) for s in (x, y)]
        if jaccard.linked(x, y):
            assert jaccard.near(np.array(len(x)), np.array(len(y)), np.bitwise_count(bits[0] ^ bits[1]).sum(dtype=np.int64))


def test_one_of_each(spark):
    docs = documents(spark, near_rows(), clash=True)
    out = jaccard.one_of_each(docs)
    want = {d for d, _, c in brute_links(near_rows()) if d is None or d == c}
    assert out.columns == docs.columns and {r.doc_id for r in out.select("doc_id").collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    out = {r.node: r.label for r in components.components(edges).collect()}
    assert out == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}


# 8 ----------------------------------------------------------------------------------------------------------------
def test_fuse_filter():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 100, 5000, 100_000):
        keys = r.integers(0, 1 << 63, n, dtype=np.uint64)
        made = dedup.BinaryFuse.from_bytes(dedup.BinaryFuse.build(np.concatenate([keys, keys])).to_bytes())
        assert made.contains(keys).all()
        if n > 100:
            assert made.contains(r.integers(0, 1 << 63, 50_000, dtype=np.uint64)).mean() < 0.01
            assert len(made.cells) < 1.4 * n + 1000


@pytest.mark.parametrize("snapshot", [None, "true", "false", "doc_id > 5"])
def test_copies(spark, snapshot):
    rows = ODD + [(30 + i, "copy " * (i % 3)) for i in range(12)] + [(None, "same")]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    docs = documents(spark, rows, clash=True)
    documents_, found = dedup.find_copies(docs, snapshot and F.expr(snapshot))
    out = documents_.join(found, dedup.KEY).select("id", "top.id", "size", F.struct("id", "rid").eqNullSafe(F.col("top")).alias("kept")).toDF("id", "keep", "size", "kept").collect()
    want = collections.Counter((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
    assert collections.Counter((r.id, r.keep, r["size"]) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    kept = dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(groups)
    assert dedup.drop_copies(documents(spark, [])).count() == 0


# 9 ----------------------------------------------------------------------------------------------------------------
def test_media_round_trip(spark):
    rows = [*ODD, (50, "".join(random.Random(1).choice("ab\x7f é") for _ in range(9000)))]
    out = avi.stored_digests(documents(spark, rows, clash=True)).collect()
    assert len(out) == len(rows)
    texts = collections.defaultdict(list)
    for d, t in rows:
        texts[d].append(t)
    seen = {}
    for r in out:
        raw = (texts[r.doc_id][0] or "").encode()
        padded = raw + b" " * (192 - len(raw) if not raw else -len(raw) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert seen.setdefault(raw, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    assert avi.stored_digests(documents(spark, [])).count() == 0


def test_any_bytes_survive():
    data = np.random.default_rng(2).integers(0, 256, 192 * 40, dtype=np.uint8).tobytes()
    (file,) = avi.write_all([data])
    head, at = avi.parse(file)
    assert head["frames"] == len(at) == 40 and avi.read_all([file])[1].tobytes() == data
    for (start, size), want in zip(at.tolist(), avi.read_all([file])[1], strict=True):
        pixels = avi.decode_frame(file[start : start + size])
        assert (pixels == np.repeat(np.repeat(want.reshape(12, 16), 8, 0), 8, 1)).all()
    with pytest.raises(ValueError, match="AVI"):
        avi.parse(b"RIFFxxxxWAVE")


def test_shots_by_brute_force(spark):
    flat = lambda v, n: bytes([v]) * (192 * n)
    media = spark.createDataFrame([(1, bytearray(avi.write_all([flat(10, 6) + flat(200, 5) + flat(90, 1)])[0])), (2, bytearray(avi.write_all([flat(7, 3)])[0])), (3, None)], "doc_id long, media binary")
    rows = sorted(tuple(r) for r in avi.clip_rows(media).collect())
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [(1, 0, 0, 5, 0, 240, 10_000), (1, 1, 6, 10, 240, 440, 200_000), (1, 2, 11, 11, 440, 480, 90_000), (2, 0, 0, 2, 0, 120, 7_000)]


# 10 ---------------------------------------------------------------------------------------------------------------
def test_rules(spark):
    urls = ["http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://x.com", "http://example.com/de/", "http://x.net/en/", None, "nothing", "ftp://h.org#a/b", "http://xcom/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in linkgraph.verdicts(pages).collect()}
    assert out[0] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert out[1] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert out[2][2:] == ("net/es/", "block") and out[3][2:] == ("net/fr/", "block") and out[5][2:] == ("com/", "allow")
    assert out[4] == ("x.com", "", None, "allow") and out[7] == out[8] == ("", "", None, "allow") and out[9] == ("h.org", "", None, "allow") and out[10][2] is None
    assert out[6] == ("x.net", "/en/", None, "block")  # half of the host's pages are blocked


def test_propagation_equals_dense(spark):
    r = random.Random(3)
    n = 15
    links = collections.Counter((r.randrange(n - 3), r.randrange(n)) for _ in range(60))  # the last three link to nothing
    e = spark.createDataFrame([(f"h{a}", f"h{b}", k) for (a, b), k in links.items()], "src string, dst string, n long")
    mass = np.array([r.random() if i % 3 else 0.0 for i in range(n)])
    s = spark.createDataFrame([(f"h{i}", float(m)) for i, m in enumerate(mass)], "host string, mass double")
    step = np.zeros((n, n))
    for (a, b), k in links.items():
        step[a, b] = k
    out = step.sum(axis=1)
    loose = out == 0
    step[~loose] /= out[~loose, None]
    trust, distrust = mass.copy(), mass.copy()
    for _ in range(400):
        trust = 0.15 * mass + 0.85 * (step.T @ trust + trust[loose].sum() * mass / mass.sum())
        distrust = mass + (1 - mass) * 0.85 * (step @ distrust)
    shares = linkgraph._shares(e)
    got = [{x.host: x.score for x in f(shares, s).collect()} for f in (linkgraph.trust_of, linkgraph.distrust_of)]
    assert all(abs(got[0][f"h{i}"] - trust[i]) < 1e-5 and abs(got[1][f"h{i}"] - distrust[i]) < 1e-5 for i in range(n))
    assert sum(got[0].values()) == pytest.approx(mass.sum()) and max(got[1].values()) <= 1


def test_verdict_does_not_depend_on_the_number_of_linkers(spark):
    for farm in (1, 2, 100):
        rows = [(i, f"http://f{i}.org/", '<a href="http://bad.net/es/">x</a>') for i in range(farm)] + [(1000, "http://bad.net/es/1", None), (1001, "http://mixed.org/", '<a href="http://bad.net/">x</a><a href="http://a.org/">y</a><a href="http://b.org/">y</a>')]
        hosts = {r.host: r.verdict for r in linkgraph.host_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(hosts[f"f{i}.org"] == "block" for i in range(farm)) and hosts["mixed.org"] == hosts["a.org"] == "allow"


def test_url_verdicts_of_odd_rows(spark):
    """Clashing columns, repeated rows, nulls."""
    rows = [(1, "http://x.net/es/", "t"), (1, "http://x.net/es/", "t"), (None, "http://x.net/en/", None), (2, None, '<a href="//y.org">'), (3, "http://y.org/" + "a" * 2_000_000, "<p>" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "score", "mass", "n", "src")})
    out = collections.Counter((r.page_id, r.host, r.rule, r.verdict) for r in linkgraph.verdicts(pages).collect())
    assert out == collections.Counter({(1, "x.net", "net/es/", "block"): 2, (None, "x.net", None, "block"): 1, (2, "", None, "allow"): 1, (3, "y.org", None, "allow"): 1})


def test_distrust_goes_against_links(spark):
    html = '<a href="http://bad.net/es/">x</a> <img src=//cdn.org/a> <a href="/own">y</a>'
    pages = spark.createDataFrame([(1, "http://farm.org/", html), (2, "http://bad.net/es/1", None), (3, "http://bad.net/es/2", ""), (4, "http://good.com/", '<a href="https://friend.org">z</a>'), (5, "http://friend.org/", None)], "page_id long, url string, html string")
    hosts = {r.host: r for r in linkgraph.host_verdicts(pages).collect()}
    assert hosts["bad.net"].verdict == "block" and hosts["farm.org"].distrust > 0 and hosts["farm.org"].trust == 0 and hosts["friend.org"].trust > 0 and hosts["cdn.org"].distrust == 0
    assert linkgraph.verdicts(pages.limit(0)).count() == 0


# common -----------------------------------------------------------------------------------------------------------
def test_kth_largest(spark):
    values = [5, 5, 5, 9, 1, 0, 1 << 61, 77, 77]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for k, want in enumerate(sorted(values, reverse=True), 1):
        assert common.kth_largest(df, "v", k) == want
    assert common.kth_largest(df, "v", 0) is None and common.kth_largest(df.limit(0), "v", 3) is None and common.kth_largest(df, "v", 99) == 0


def test_other_folder(spark, monkeypatch):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
