"""Native text as blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import WS, classify_text, escape_pipe, strip

_BREAK = r"[\n\u000b\u000c\u001c-\u001e\u0085  ]"


def cells(line: Column) -> Column:
    """The cells of a line: between tabs if it has any, else between runs of white space."""
    parts = F.when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, f"{WS}{{2,}}"))
    return F.filter(F.transform(parts, strip), lambda c: c != "")


def is_table(rows: Column) -> Column:
    """At least two lines of two cells or more, of at most two different lengths."""
    sizes = F.filter(F.transform(rows, F.size), lambda n: n >= 2)
    return (F.size(rows) >= 2) & (F.size(sizes) >= 2) & (F.size(F.array_distinct(sizes)) <= 2)


def markdown_table(rows: Column) -> Column:
    """A Markdown table of rows of cells, the first as its head, short rows padded."""
    wide = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, escape_pipe), F.array_repeat(F.lit(""), (wide - F.size(r)).cast("int"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide.cast("int")), " | "), F.lit(" |"))
    drawn = F.transform(rows, line)
    return F.array_join(F.concat(F.slice(drawn, 1, 1), F.array(rule), F.slice(drawn, F.lit(2), F.greatest(F.size(drawn) - 1, F.lit(0)))), "\n")


def text_to_blocks(docs: DataFrame, engine: str = "text") -> DataFrame:
    """(doc_id, block_seq, type, text, n_lines, confidence, engine): paragraphs between blank lines, and tables."""
    clean = strip(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"))
    parts = docs.select("doc_id", F.posexplode(F.split(clean, rf"\n{WS}*\n+")).alias("block_seq", "raw"))
    lined = parts.withColumn("lines", F.filter(F.transform(F.split("raw", _BREAK), strip), lambda x: x != "")).where(F.size("lines") > 0)
    lined = lined.withColumn("rows", F.transform("lines", cells))
    flat = F.array_join("lines", " ")
    tabular = is_table(F.col("rows"))
    return lined.select(
        "doc_id",
        "block_seq",
        F.when(tabular, "table").otherwise(classify_text(flat, F.size("lines"))).alias("type"),
        F.when(tabular, markdown_table(F.col("rows"))).otherwise(flat).alias("text"),
        F.size("lines").alias("n_lines"),
        F.when(tabular, 90.0).otherwise(100.0).alias("confidence"),
        F.lit(engine).alias("engine"),
    )
