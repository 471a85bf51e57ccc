"""The structure of calls: raw text to typed turns in one pass over its lines, and what is derived from turns.

A line is `Name: text` or `Name (title): text`, which opens a turn of that speaker; `Q: text` or `A: text`, a turn of a question or an answer, after which no speaker
is current; or anything else, which goes on with the current speaker's turn, or is a turn of its own of UNKNOWN. Lines of a turn are joined by spaces, blank lines don't count.
The questions' section begins with the first speaker whose title says analyst; before it, and without one, are the opening remarks.

Lines carry the last opening before them by a window over their call; a call is one document, calls are dealt over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAMED = r"^([A-Z][\w.' -]{1,60}?)(?:\s*\(([^()]*)\))?\s*:\s*(.*)$"
ASKED = r"(?i)^(q|a|question|answer)\s*:\s*(.*)$"
REMARKS, QUESTIONS = "Opening Remarks", "Q&A Session"
LABELS = {"q": "Q", "question": "Q", "a": "A", "answer": "A"}


def turns(raw: DataFrame, call: str, text: str) -> DataFrame:
    """call, seq, section, speaker, title, kind (statement or qa) and content of the turns of raw calls. Null and blank texts have none."""
    upto = Window.partitionBy(call).orderBy("at")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(call).orderBy("seq")
    lines = raw.select(call, F.posexplode(F.split(text, r"\r?\n")).alias("at", "line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).filter("line <> ''")
    asked, named = F.col("line").rlike(ASKED), F.col("line").rlike(NAMED)
    kinds = lines.withColumn("kind", F.when(asked, "qa").when(named, "statement"))
    kinds = kinds.withColumn("last", F.last("kind", ignorenulls=True).over(before))
    alone = F.col("kind").isNull() & (F.coalesce(F.col("last"), F.lit("qa")) == "qa")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv)), F.lower(F.regexp_extract("line", ASKED, 1)))
    part = lambda pattern, k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    opened = kinds.withColumns({
        "opens": (F.col("kind").isNotNull() | alone).cast("int"),
        "speaker": F.when(F.col("kind") == "qa", label).when(F.col("kind") == "statement", part(NAMED, 1)).when(alone, "UNKNOWN"),
        "title": F.when(F.col("kind") == "statement", part(NAMED, 2)),
        "body": F.when(F.col("kind") == "qa", F.regexp_extract("line", ASKED, 2)).when(F.col("kind") == "statement", F.regexp_extract("line", NAMED, 3)).otherwise(F.col("line")),
    })
    numbered = opened.withColumn("seq", F.sum("opens").over(upto).cast("int"))
    said = F.array_sort(F.collect_list(F.struct("at", "body")))  # of one turn
    out = numbered.groupBy(call, "seq").agg(F.min_by("speaker", "at").alias("speaker"), F.min_by("title", "at").alias("title"), F.coalesce(F.min_by("kind", "at"), F.lit("statement")).alias("kind"), said.alias("said"))
    out = out.withColumn("content", F.array_join(F.filter(F.transform("said", lambda x: x["body"]), lambda b: b != ""), " "))
    analyst = F.max(F.coalesce(F.lower("title").contains("analyst"), F.lit(False))).over(whole)
    return out.select(call, "seq", F.when(analyst, QUESTIONS).otherwise(REMARKS).alias("section"), "speaker", "title", "kind", "content")


def _line():
    return F.concat("speaker", F.lit(": "), "content")


def sections(rows: DataFrame, call: str) -> DataFrame:
    """call, section, text (a line a turn, in order), turns, and titles: a map from each speaker to the first title that is given (empty if none is)."""
    title = F.min_by("title", F.when(F.col("title").isNotNull(), F.col("seq")))
    people = rows.groupBy(call, "section", "speaker").agg(F.coalesce(title, F.lit("")).alias("title"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("seq", _line().alias("line")))).alias("said"))
    lines = F.transform(F.array_sort(F.flatten(F.collect_list("said"))), lambda x: x["line"])
    return people.groupBy(call, "section").agg(F.array_join(lines, "\n").alias("text"), F.sum("n").alias("turns"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker", "title")))).alias("titles"))


def records(rows: DataFrame, call: str) -> DataFrame:
    """call, participants (in the order in which they are first heard), turns, and the structured text: each section under its heading, a line a turn."""
    heard = rows.groupBy(call, "speaker").agg(F.min("seq").alias("seq"))
    people = heard.groupBy(call).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "speaker"))), lambda x: x["speaker"]).alias("participants"))
    own = sections(rows, call)
    part = F.concat(F.upper("section"), F.lit("\n"), F.repeat(F.lit("-"), F.length("section")), F.lit("\n"), F.col("text"))
    texts = own.groupBy(call).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("section") == QUESTIONS).alias("later"), part.alias("part")))), lambda x: x["part"]), "\n\n").alias("text"), F.sum("turns").alias("turns"))
    return people.join(texts, call)
