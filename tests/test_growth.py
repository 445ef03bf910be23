"""What makes queries on lines cost no more than the input asks for: texts moved once, blocks made once, no work a line doesn't need."""

import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions import formula
from leafmill.functions import text as T
from leafmill.operators import layout
from leafmill.plans import catalog, relations

SF = "/root/testdata/sf0.001"


def plan(frame):
    text = frame._jdf.queryExecution().executedPlan().toString()
    return text.count("FileScan"), len(re.findall(r"(?<!Broadcast)Exchange (?!Single)", text))


@pytest.mark.parametrize("name", ["layout_pipeline", "reading_order_2col", "column_split", "page_summary", "isolation_score", "rag_chunks", "render_legacy", "render_text", "paragraph_merge_native"])
def test_texts_are_read_and_moved_once(spark, name):
    assert plan(catalog.QUERIES[name](spark, SF)) == (1, 1)


@pytest.mark.parametrize("name, reads, moves", [("block_type_accuracy", 2, 2), ("document_scores", 3, 5)])
def test_each_side_is_made_once(spark, name, reads, moves):
    """Actual and expected blocks, and the list of documents; scores are moved twice more, for the pivot."""
    assert plan(catalog.QUERIES[name](spark, SF)) == (reads, moves)


def test_large_tables_have_partitions_by_size(spark):
    rows = spark.range(10).selectExpr("id AS doc_id")
    assert relations.spread(rows, "doc_id", 100 << 20).rdd.getNumPartitions() == 25
    assert relations.spread(rows, "doc_id", 1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_columns_are_not_filtered_by_type(spark):
    """A filter on the type is pushed to the lines, where the type is made anew for each place that names it."""
    filters = [x for x in catalog.QUERIES["column_split"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in x]
    assert not any("RLIKE" in x for x in filters)


def test_white_space(spark):
    """Trimmed characters are those of the pattern, and squeezing by runs is squeezing by the pattern."""
    every = spark.range(1, 0x10000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert {chr(r.id) for r in every.where(F.col("c").rlike(f"^{T.WS}")).collect()} == set(T.SPACES)
    s = "\t 　a  b c\td  e\n\nf  "
    rows = spark.createDataFrame([(x,) for x in [s, "", " ", " a", "a b", "a\u0085b", "a \tb", "\ta", None, *["".join((s * 2)[i : i + n]) for i in range(len(s)) for n in (1, 3, 7)]]], "t string")
    old = F.regexp_replace(F.regexp_replace("t", f"{T.WS}+", " "), f"^{T.WS}+|{T.WS}+$", "")
    got = rows.select("t", T.squeeze(F.col("t")).alias("a"), old.alias("b"), T.strip(F.col("t")).alias("c"), F.regexp_replace("t", f"^{T.WS}+|{T.WS}+$", "").alias("d")).collect()
    assert [(r.a, r.c) for r in got] == [(r.b, r.d) for r in got]


def test_units_and_prose(spark):
    old = r"(?<![A-Za-z])(?i:%|‰|°C|°F|GPa|MPa|kPa|Pa|psi|bars?|kN/m2|kN/m²|kN|km/h|km|cm|mm|m/s|m|kg|g|t)(?![A-Za-z])"
    parts = ["5", " ", "kN", "/m2", "m/s", "KM/H", "%", "x", "°c", "°", "bar", "bars", "barss", "Pa", "gpa", "T", "sin", "the", "Soil", "tan", "of", "ab", "word", "=", "sinX", "pr"]
    rows = spark.createDataFrame([(a + s + b + t + c,) for a in parts for b in parts for c in parts[::2] for s, t in (("", " "), (" ", ""), (" ", " "))], "t string")
    words = F.regexp_extract_all("t", F.lit("[A-Za-z]+"), F.lit(0))
    prose = F.size(F.filter(words, lambda w: w.rlike("^[a-z]{3,}$") & ~w.rlike(f"^(?i:{formula.FUNCTIONS})$"))) >= 2
    off = rows.where((F.col("t").rlike(old) != F.col("t").rlike(T.UNITS)) | (prose != formula.is_prose(F.col("t"))))
    assert off.take(3) == []


def test_isolation_of_some(spark):
    """Blocks that aren't asked for have no isolation, the others the same; a block without a box counts for none."""
    rows = [(1, 0, i, None if i == 3 else float(y), None if i == 3 else y + 12.0) for i, y in enumerate((40, 58, 58, 0, 120, 121, 400))]
    blocks = spark.createDataFrame(rows, "doc_id int, page_no int, block_seq int, y0 double, y1 double")
    every = {r.block_seq: r.isolation for r in layout.isolation(blocks, 792.0).collect()}
    some = {r.block_seq: r.isolation for r in layout.isolation(blocks, 792.0, F.col("block_seq") % 2 == 0).collect()}
    assert every[3] is None and some == {k: v if k % 2 == 0 else None for k, v in every.items()}
