"""Rows of text to rows of chunks. Generators run in Python by Arrow batches; a document is never held with others."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.workers import mapped


#: Characters and rows after which a task gives out what it has made.
GIVEN, MOST = 1 << 20, 1 << 14


def generated(df: DataFrame, id_col: str, text_col: str, make: Callable[[str | None], list[str]]) -> DataFrame:
    """id, seq and text of every chunk that `make` cuts from a text."""
    kind = dict(df.dtypes)[id_col]
    return mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), cutter(make), f"id {kind}, seq int, text string")


def cutter(make: Callable[[str | None], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of ids and texts to batches of ids, seq and chunks."""
    return labelled_cutter(lambda text: enumerate(make(text)), {"seq": pa.int32()})


def labelled_cutter(make: Callable[[str | None], Iterable[tuple]], labels: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same with labels of each chunk; make: (*labels, chunk) of a text. Batches are of about GIVEN characters, so a worker holds one batch of texts and the chunks of one text."""

    def rows(batch: pa.RecordBatch, of: list[int], made: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), [*labels.values(), pa.string()], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), *columns], ["id", *labels, "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, made, size = [], [], 0
            for i, text in enumerate(batch.column(1)):  # one text at a time becomes a string of Python
                for row in make(text.as_py()):
                    of.append(i)
                    made.append(row)
                    size += len(row[-1])
                    if size >= GIVEN or len(made) >= MOST:
                        yield rows(batch, of, made)
                        of, made, size = [], [], 0
            if made:
                yield rows(batch, of, made)

    return run


def grains(df: DataFrame, id_col: str, text_col: str, size: int = 300, overlap: int = 60) -> DataFrame:
    """id, seq, part, granularity and text: chunks of a text by paragraph (macro), and small ones of each (micro, numbered by part), in one pass over the texts."""

    def both(text: str | None) -> Iterator[tuple]:
        for k, macro in enumerate(tx.paragraph_chunks(text)):
            yield k, 0, "macro", macro
            for part, micro in enumerate(tx.micro_chunks(macro, size, overlap)):
                yield k, part, "micro", micro

    kind = dict(df.dtypes)[id_col]
    return mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), labelled_cutter(both, {"seq": pa.int32(), "part": pa.int32(), "granularity": pa.string()}), f"id {kind}, seq int, part int, granularity string, text string")


def sentence_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 150) -> DataFrame:
    return generated(df, id_col, text_col, lambda t: tx.distinct_chunks(tx.sentence_chunks(t, size, overlap), size))


def paragraph_chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return generated(df, id_col, text_col, tx.paragraph_chunks)


def micro_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 300, overlap: int = 60) -> DataFrame:
    return generated(df, id_col, text_col, lambda t: tx.micro_chunks(t, size, overlap))


def call_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 800, overlap: int = 150) -> DataFrame:
    """Sentences of calls, with overlap from the last speaker on; one chunk of each beginning."""
    return generated(df, id_col, text_col, lambda t: tx.distinct_chunks(tx.call_chunks(t, size, overlap), size))


def turn_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 800) -> DataFrame:
    return generated(df, id_col, text_col, lambda t: tx.turn_chunks(t, size))


def remark_chunks(df: DataFrame, id_col: str, text_col: str, size: int = 800) -> DataFrame:
    return generated(df, id_col, text_col, lambda t: tx.remark_chunks(t, size))


def one_of_each_start(chunks: DataFrame, group: list[str], seq: str, text: str, size: int = 800) -> DataFrame:
    """Of chunks of a group with the same first 100 characters the first; then those of 20 characters to 1.2 times the size."""
    mark = F.lower(tx.collapsed(F.substring(text, 1, 100)))
    first = chunks.withColumn("_mark", mark).withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_mark").orderBy(seq))).filter("_rn = 1").drop("_rn", "_mark")
    return first.filter(F.length(text).between(20, int(size * 1.2)))


def enriched(chunks: DataFrame, text: str = "text", section: str = "section_name") -> DataFrame:
    """With hash, numeric density, tags and the section inferred."""
    return chunks.withColumns({"text_hash": F.md5(text), "numeric_density": tx.numeric_density(F.col(text)), "tags": tx.tags(F.col(text)), "section": tx.section_of(F.col(section), F.col(text))})


def one_of_each_hash(chunks: DataFrame, *order: str) -> DataFrame:
    """One chunk of each text, the first in this order; partial before it moves, so copies cost nothing."""
    cols = [c for c in chunks.columns if c != "text_hash"]
    return chunks.groupBy("text_hash").agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("_c")).select("text_hash", *(F.col("_c")[c].alias(c) for c in cols))


class _Text(HTMLParser):
    """The text of a page, and its tables as rows of cells."""

    SKIP, BREAK = {"script", "style", "head", "nav"}, {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "table", "article", "section"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("\n")
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP and self.hidden:
            self.hidden -= 1
        if tag in self.BREAK:
            self.parts.append("\n")
        if tag in ("td", "th") and self.cell is not None and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.cell is not None:
                self.cell.append(data)


def parsed_page(html: str | None) -> _Text:
    """A page, also one that breaks off within a reference or a tag."""
    parser = _Text()
    parser.feed(html or "")
    parser.close()
    return parser


def html_lines(html: str | None) -> list[str]:
    """Lines of a page's text; those with under 40 % letters and digits, or one character over 10 times in a row, go."""
    import re

    lines = (" ".join(x.split()) for x in "".join(parsed_page(html).parts).split("\n"))
    return [x for x in lines if x and sum(c.isalnum() for c in x) >= 0.4 * len(x) and not re.search(r"(.)\1{10,}", x)]


def html_text(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return generated(df, id_col, html_col, lambda h: ["\n".join(html_lines(h))])


def html_tables(df: DataFrame, id_col: str, html_col: str, most_chars: int | None = None, most_rows: int | None = None) -> DataFrame:
    """A row for each table row of a page (cells joined by tabs). If asked for, tables over a size are left out, and rows over a number; by default all are kept."""

    def rows(html: str | None) -> list[str]:
        tables = (t for t in parsed_page(html).tables if most_chars is None or sum(len(c) for r in t for c in r) <= most_chars)
        return ["\t".join(r) for t in tables for r in t[:most_rows] if r]

    return generated(df, id_col, html_col, rows)


BREAK = "\n\n--- SECTION BREAK ---\n\n"


def item_sections(text: str | None, patterns: dict[str, str], ignored: tuple[str, ...] = (), gap: int = 100) -> list[tuple[str, str]]:
    """Sections of a filing: every place where a pattern occurs up to the next place of any; places of one section are joined. What lies between sections is `unclassified`, in pieces over `gap` characters."""
    import re

    flat = re.sub(r"\s+", " ", text or "")
    flat = re.sub(r"(?i)\s(item\s+\d+[a-z]?\.)", r"\n\1", flat)
    starts = sorted((m.start(), name) for name, p in patterns.items() for m in re.finditer(p, flat, re.I))
    spans: dict[str, list[str]] = {}
    first = starts[0][0] if starts else len(flat)
    rest = [flat[:first].strip()] if len(flat[:first].strip()) > gap else []
    for (a, name), b in zip(starts, [*(s for s, _ in starts[1:]), len(flat)], strict=True):
        if b > a and name not in ignored:
            spans.setdefault(name, []).append(flat[a:b].strip())
    return [(name, BREAK.join(parts)) for name, parts in spans.items()] + [("unclassified", r) for r in rest]


def filing_sections(df: DataFrame, id_col: str, text_col: str, patterns: dict[str, str], ignored: tuple[str, ...] = ()) -> DataFrame:
    """id, seq, section and text of the sections of filings."""
    out = generated(df, id_col, text_col, lambda t: [f"{n}\x1f{x}" for n, x in item_sections(t, patterns, ignored)])
    return out.select("id", "seq", F.split_part("text", F.lit("\x1f"), F.lit(1)).alias("section"), F.split_part("text", F.lit("\x1f"), F.lit(2)).alias("text"))
