"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a hash, form one stream of words, cut into blocks of equal size: about BLOCK words, or a part in
MOST_BLOCKS of the source if that is more, so blocks grow with the input and their number doesn't.
A slot of the schedule takes one block. Slot i is the golden-ratio point frac(i * 0.618...), in whole numbers of 2**-POINT_BITS
so that points stay apart however many slots there are, mapped through the cumulative quotas of the sources: every stretch of the schedule has the
right shares. Slots are ranked within their source, and rank r takes block r modulo the number of blocks (a repeat for each time round). What
discrepancy leaves over or short of a quota is cut off, or added at the end, so each source's words are within half a block of its target.

Nothing is gathered by source: offsets and ranks are prefix sums in two levels (within a bucket or chunk, and over the
sums of these), and what holds for a source reaches its documents through the table of buckets. Only the table of sources
(a row each) is ordered in one task. A lost executor costs its running tasks; reruns give the same mix.

Defined results: null text has size 0; null source is a source of its own, the last one; empty texts are taken 0 times;
rows of a repeated doc_id are each a document; equal hashes are ordered by doc_id, then by row; an empty table gives an
empty result; other columns are not read (mix_documents() passes them on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table

WEIGHTS, MOST, BLOCK, MOST_BLOCKS, SEED = (5, 2, 1), 3, 64, 1 << 20, 77
#: Bits of a point, and the golden ratio's part in them: floor(2 ** 62 * (5 ** 0.5 - 1) / 2).
POINT_BITS, GOLDEN = 62, 0x278DDE6E5FD29F05
#: Documents of a bucket, slots of a chunk, bits of the cells of the map from points to sources, least buckets.
BUCKET_DOCS, CHUNK, CELL_BITS, LEAST_BUCKETS = 1 << 16, 1 << 13, 10, 64


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, skey, place (in the shuffle) and rid of each row."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), source_key(F.col(source_col).cast("string")).alias("skey"), F.xxhash64(F.col(id_col).cast("long"), F.lit(SEED)).alias("place"), F.monotonically_increasing_id().alias("rid"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """skey, source_size (given) with target: shares of the whole by weight, at most `most` times the source's size.

    With sources ordered by cap / weight, those that stop at their cap come first; the level of the others is what is left over their weights."""
    order = Window.orderBy(F.col("skey") == "n", "skey")
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most).withColumn("limit", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("limit", "skey")
    before, here = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(here)
    leveled = ranked.withColumn("level", level).withColumn("rank", F.row_number().over(rising))
    first = F.min_by(F.when(F.col("level") <= F.col("limit"), F.col("level")), F.when(F.col("level") <= F.col("limit"), F.col("rank"))).over(Window.partitionBy())
    return leveled.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(first * F.col("weight"), F.col("cap").cast("double")))).select("skey", "source_size", "weight", "target")


def quotas(aimed: DataFrame, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """With n_blocks, and quota: blocks to take of each source, in order and round and round, so that their words come nearest to the target; and low and high, the points that are its own.

    The first blocks of a source are a word longer than the others."""
    words = F.greatest(F.lit(block), F.expr(f"source_size div {most_blocks}"))
    out = aimed.withColumn("n_blocks", F.ceil(F.col("source_size") / words).cast("long"))
    base, long = F.expr("source_size div greatest(n_blocks, 1)"), F.expr("source_size % greatest(n_blocks, 1)")
    rounds = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.col("target") - rounds * F.col("source_size")
    last = F.when(rest <= long * (base + 1), F.round(rest / (base + 1))).otherwise(long + F.round((rest - long * (base + 1)) / F.greatest(base, F.lit(1))))
    quota = F.when(F.col("source_size") > 0, F.least((rounds * F.col("n_blocks") + last).cast("long"), F.col("n_blocks") * MOST)).otherwise(0)
    out = out.withColumn("quota", quota)
    before = F.coalesce(F.sum("quota").over(Window.orderBy("skey").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.greatest(F.sum("quota").over(Window.partitionBy()), F.lit(1))
    bound = lambda at: (at.cast("decimal(18,0)") * F.lit(1 << POINT_BITS).cast("decimal(20,0)") / whole.cast("decimal(18,0)")).cast("decimal(38,0)").cast("long")
    return out.withColumn("low", bound(before)).withColumn("high", bound(before + F.col("quota")))


def point_of(slot: Column) -> Column:
    """slot * GOLDEN modulo 2 ** POINT_BITS, in parts that don't overflow; slot has 40 bits at most."""
    mask = F.lit((1 << POINT_BITS) - 1)
    part = lambda shift, bits: slot * F.lit(GOLDEN >> shift & ((1 << bits) - 1))
    first = part(0, 21) + F.shiftleft(part(21, 21).bitwiseAND(F.lit((1 << 41) - 1)), 21)
    return (first.bitwiseAND(mask) + F.shiftleft(part(42, 20).bitwiseAND(F.lit((1 << 20) - 1)), 42)).bitwiseAND(mask)


def schedule(quota: DataFrame) -> DataFrame:
    """slot, skey, rank, n_blocks: the order in which blocks are taken; rank counts within the source."""
    spark = quota.sparkSession
    n = quota.agg(F.sum("quota")).first()[0] or 0
    shift = POINT_BITS - CELL_BITS
    slots = spark.range(n).select(F.col("id").alias("slot"), point_of(F.col("id")).alias("point")).withColumn("cell", F.shiftright("point", shift))
    spans = quota.filter("quota > 0").select("skey", "n_blocks", "quota", "low", "high", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"))
    placed = slots.join(spans, "cell").filter("point >= low and point < high").select("slot", "skey", "n_blocks", "quota", F.expr(f"slot div {CHUNK}").alias("chunk"))
    placed = stored(placed, "slots")
    chunks = placed.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("skey").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("skey", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(chunks.select("skey", "chunk", "ahead"), ["skey", "chunk"]).withColumn("rank", F.col("ahead") + F.col("within"))
    counts = chunks.groupBy("skey").agg(F.sum("n").alias("had"))
    tail = quota.filter("quota > 0").join(counts, "skey", "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < quota")
    tail = tail.select(F.lit(n).alias("slot"), "skey", F.explode(F.sequence("had", F.col("quota") - 1)).alias("rank"), "n_blocks")
    return ranked.filter("rank < quota").select("slot", "skey", "rank", "n_blocks").unionByName(tail)


def mixed(light: DataFrame, block: int = BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """rid, doc_id, size, source_size, target and taken (words, repeats counted) for a stored table of sized()."""
    buckets = max(LEAST_BUCKETS, -(-light.count() // BUCKET_DOCS))
    light = light.withColumn("bucket", F.pmod("place", F.lit(buckets)))
    sums = stored(light.groupBy("skey", "bucket").agg(F.sum("size").alias("words")), "bucketsums")
    quota = stored(quotas(targets(sums.groupBy("skey").agg(F.sum("words").alias("source_size"))), block, most_blocks), "quotas")
    times = schedule(quota).groupBy("skey", F.expr("rank % n_blocks").alias("block")).agg(F.count(F.lit(1)).alias("times"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("ahead", ahead).join(quota.select("skey", "source_size", "target", "n_blocks"), "skey")
    run = Window.partitionBy("skey", "bucket").orderBy("place", "doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    at = light.withColumn("upto", F.sum("size").over(run)).join(placed.select("skey", "bucket", "ahead", "source_size", "target", "n_blocks"), ["skey", "bucket"])
    at = at.withColumn("a", F.col("ahead") + F.col("upto") - F.col("size")).withColumn("base", F.expr("source_size div greatest(n_blocks, 1)")).withColumn("long", F.expr("source_size % greatest(n_blocks, 1)"))
    at = at.withColumn("n_long", F.expr("long * (base + 1)"))
    block_of = "case when {0} < n_long then ({0}) div (base + 1) else long + ({0} - n_long) div greatest(base, 1) end"
    spans = F.when(F.col("size") > 0, F.sequence(F.expr(block_of.format("a")), F.expr(block_of.format("(a + size - 1)"))))
    pieces = at.withColumn("block", F.explode_outer(spans))
    start = "{0} * base + least({0}, long)"
    pieces = pieces.withColumn("words", F.expr(f"least(a + size, {start.format('(block + 1)')}) - greatest(a, {start.format('block')})"))
    out = pieces.select("rid", "doc_id", "size", "source_size", "target", "skey", "block", "words").join(times, ["skey", "block"], "left")
    return out.groupBy("rid", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row as often as the mix takes its words (rounded, half up), columns as they are."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names)
    ident, text, source = (names[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    light = stored(sized(own, ident, text, source).drop("rid").withColumn("rid", F.lit(0).cast("long")).groupBy("doc_id", "size", "skey", "place").agg(F.count(F.lit(1)).alias("rows")).withColumn("rid", F.monotonically_increasing_id()), "sized")
    # rows that repeat a document's id, size and source are one document of their joint size, and share what it is given
    grouped = light.withColumn("one", F.col("size")).withColumn("size", F.col("size") * F.col("rows"))
    times = mixed(grouped.select("doc_id", "size", "skey", "place", "rid")).join(light.select("rid", F.col("skey").alias("key"), F.col("size").alias("one")), "rid")
    times = times.select(F.col("doc_id").alias("mix_id"), "key", "one", F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + F.lit(0.5)).cast("int").alias("copies")).filter("copies > 0")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    marked = own.withColumn("own_id", F.col(ident).cast("long")).withColumn("own_words", words).withColumn("own_key", source_key(F.col(source).cast("string")))
    taken = marked.join(times.hint("merge"), F.col("own_id").eqNullSafe(F.col("mix_id")) & (F.col("own_key") == F.col("key")) & (F.col("own_words") == F.col("one")))
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixed(stored(sized(table(spark, sf_dir, "documents")), "sized")).select("doc_id", "size", "source_size", "target", "taken")
