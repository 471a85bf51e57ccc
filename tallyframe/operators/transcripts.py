"""Transcripts of calls: rows (call, seq, speaker, content, is_analyst, is_management) to sections, questions and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def _upto(call: str, seq: str) -> Window:
    return Window.partitionBy(call).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def split_at_first_analyst(rows: DataFrame, call: str = "conv_id", seq: str = "seq") -> DataFrame:
    """section: remarks before the first analyst, questions from there on."""
    return rows.withColumn("section", F.when(F.max("is_analyst").over(_upto(call, seq)) == 1, "questions").otherwise("remarks"))


def groups_by_analyst(rows: DataFrame, call: str = "conv_id", seq: str = "seq") -> DataFrame:
    """group: a new one at each analyst; 0 before the first."""
    return rows.withColumn("group", F.sum("is_analyst").over(_upto(call, seq)).cast("int"))


def question_chunks(rows: DataFrame, call: str = "conv_id", seq: str = "seq") -> DataFrame:
    """One chunk for each group: its entries in order, each after its speaker; and the first speaker who is no analyst. A group is a few turns of one call."""
    grouped = groups_by_analyst(rows, call, seq).filter("group > 0")
    said = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("at"), F.concat(F.col("speaker"), F.lit(": "), F.col("content")).alias("text"))))
    primary = F.min_by(F.when(F.col("is_analyst") == 0, F.col("speaker")), F.when(F.col("is_analyst") == 0, F.col(seq)))
    return grouped.groupBy(call, "group").agg(F.concat_ws("\n\n", F.transform(said, lambda x: x["text"])).alias("text"), primary.alias("primary"), F.count(F.lit(1)).cast("int").alias("entries"))


def pairs(rows: DataFrame, call: str = "conv_id", seq: str = "seq") -> DataFrame:
    """pair: a question opens one; answers before the first are left out."""
    asked = rows.withColumn("opens", tx.question(F.col("content")).cast("int"))
    return asked.withColumn("pair", F.sum("opens").over(_upto(call, seq)).cast("int")).filter("pair > 0")


def labelled(rows: DataFrame, call: str = "conv_id", seq: str = "seq") -> DataFrame:
    """label: opening_remarks, until a question, an operator or a Q&A heading makes it qa_session, or a closing word closing_remarks; it stays until the next change."""
    low = F.lower("content")
    change = F.when(tx.matches_any(low, tx.QA_PATTERNS) | F.contains(F.lower("speaker"), F.lit("operator")) | tx.question(F.col("content")), "qa_session").when(tx.matches_any(low, tx.CLOSING_PATTERNS), "closing_remarks")
    return rows.withColumn("label", F.coalesce(F.last(change, ignorenulls=True).over(_upto(call, seq)), F.lit("opening_remarks")))


def features(rows: DataFrame, call: str = "conv_id", seq: str = "seq") -> DataFrame:
    """A row for each call: lengths, participants in order of appearance, what it mentions. A call is one document."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("at"), "speaker", "content")))
    text, low = F.col("text"), F.lower("text")
    calls = rows.groupBy(call).agg(ordered.alias("said")).withColumn("text", F.concat_ws("\n", F.transform("said", lambda x: x["content"])))
    return calls.select(
        call, F.length(text).alias("content_length"), F.size(tx.tokens(text)).alias("word_count"), F.array_distinct(F.transform("said", lambda x: x["speaker"])).alias("participants"),
        low.rlike(r"\b(?:revenue|sales|income)\b").alias("revenue_mentioned"), low.rlike(r"\b(?:guidance|outlook|forecast|expect)\b").alias("guidance_mentioned"),
        tx.all_terms(text, tx.TERMS).alias("terms"), tx.all_terms(text, tx.POSITIVE).alias("positive"), tx.all_terms(text, tx.NEGATIVE).alias("negative"), tx.topics(text).alias("topics"),
    )


#: What calls say of their results, their outlook and their business; a pattern doesn't go beyond a line.
INSIGHTS = {
    "beat_consensus": "beat|exceed|above consensus",
    "missed_estimates": "miss|below|disappointed",
    "guidance_raised": r"\b(?:raise|raising|increased|improving)\b.*\b(?:guidance|outlook)\b",
    "guidance_lowered": r"\b(?:lower|lowering|reduced|cut)\b.*\b(?:guidance|outlook)\b",
    "new_products_mentioned": r"\b(?:new product|launch|introduce)\b",
    "partnerships_mentioned": r"\b(?:partnership|alliance|collaboration)\b",
    "acquisitions_mentioned": r"\b(?:acquisition|acquire|merger|bought)\b",
    "expansion_mentioned": r"\b(?:expansion|expand|growing|growth)\b",
}


def insights(rows: DataFrame, call: str = "conv_id", text: str = "content") -> DataFrame:
    """A row for each call and a flag for each of INSIGHTS: whether any turn says it. Partial before it moves; no text is gathered."""
    low = F.lower(text)
    return rows.groupBy(call).agg(*(F.coalesce(F.bool_or(low.rlike(pattern)), F.lit(False)).alias(name) for name, pattern in INSIGHTS.items()))


def speaker_chunks(rows: DataFrame, call: str = "conv_id", seq: str = "seq", words: int = 500, keep: tuple[str, ...] = ()) -> DataFrame:
    """Turns in pieces of so many words, every piece of a long turn; with further columns to keep."""
    split = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(split) - 1) / words).cast("int"), F.lit(0))), lambda k: F.array_join(F.slice(split, k * words + 1, words), " "))
    return rows.select(call, seq, "speaker", *keep, F.posexplode(pieces).alias("piece", "text")).filter("text <> ''")


def speakers_of(text: Column) -> Column:
    """Names that begin a line and end in a colon."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^([A-Z][\w.' -]{1,60}):"), F.lit(1)))


def parsed(raw: DataFrame, call: str, text_col: str) -> DataFrame:
    """call, seq, speaker and content of raw text of lines `Name: what is said`; lines without a name go on with the last one's."""
    lines = raw.select(call, F.posexplode(F.split(text_col, r"\n+")).alias("seq", "line")).filter("trim(line) <> ''")
    name = F.regexp_extract("line", r"^([A-Z][\w.' -]{1,60}):", 1)
    own = lines.withColumn("named", F.when(name != "", name)).withColumn("content", F.trim(F.regexp_replace("line", r"^[A-Z][\w.' -]{1,60}:", "")))
    return own.withColumn("speaker", F.coalesce(F.last("named", ignorenulls=True).over(_upto(call, "seq")), F.lit("Unknown"))).select(call, "seq", "speaker", "content")


#: What cleaning replaces, one after the other.
CLEANING = (
    (r"\s+", " "),
    (r"\[.*?\](?=\s|$)", ""),  # stage directions
    (r"\(.*?\)(?=\s|$)", ""),  # notes in parentheses
    (r"([.!?])\s*([A-Z])", "$1 $2"),
    (r"\s*:\s*", ": "),
    (r"\.{3,}", "..."),
    (r"-{2,}", "--"),
    ("[\u201c\u201d]", '"'),
    ("[\u2018\u2019]", "'"),
)


def cleaned(text: Column) -> Column:
    """Text of a call without stage directions and notes, with even spaces, dashes and quotes."""
    for pattern, by in CLEANING:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def missing_quarters(expected: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """Quarters to fetch: those expected that aren't held."""
    return expected.join(held.select(*key).distinct(), key, "left_anti")
