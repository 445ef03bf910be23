"""Relations derived from the driver's tables, for both engines.

The tables have no coordinates, so the geometry of a line follows from its
number; FIXTURE adds lines with what the texts lack: formulas, CJK, numbered
headings, tables, lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_LINES, WIDTH, HEIGHT = 40, 612.0, 792.0
FIXTURE: tuple[tuple[int, int, str], ...] = tuple(
    (-1 - i // 24, i % 24, text)
    for i, text in enumerate(
        [
            "Soil Behaviour Type", "1. Introduction", "1.1 Background of work", "2.1.3) Results here", "A. Appendix", "introduction", "Introduction", "Case History",
            "qc = 0.9 MPa, fs = 72 kPa", "depth 12 m below", "- first item of a list", "* second item", "3) third item", "12", "3.14 - 2", "",
            "   ", "土壤分类图", "深度 /m 真实 类别", "文 字 a 文字", "日本語のテキスト", "한국어 문장", "Ｑｃ１２ 値", "已未人 abc土",
            "qt = qc + (1 - a) u2", "By = Au / (qt - ovo)", "sigma = 5%", "∑ x² ± 3 ≈ π", "f(x) = sin(x)", "AREA =a", "g,", "u2",
            "Ql", "4]", "3/4", "friction sleeve (i.e., b = 1.0).", "Name | Amount | Total", "Alice | 42 | 7", "Bob | 7 | 9", "NAME | AGE",
            "x | y", "tofu □ here", "bad � glyph", "[x] done task", "(1) one", "（2）two", "• bullet", "This Is A Long Title Case",
            "Page 7", "- 12 -", "log(x) + exp(y) - tan(z)", "α β γ = δ", "G - Cvo) x 100 %", "fs/(qt-sv0) and 3 / 4", "[formula] Bq = u2", "ends with colon:",
        ]
    )
)


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, by: str, size: int, portion: int = 4 << 20) -> DataFrame:
    """Rows of a table of ``size`` bytes by key, in partitions of about ``portion`` bytes, and one a core at least.

    A row group is one task, whatever the number of splits, and a large table
    may have few. What is grouped by the key afterwards stays where it is, so
    texts move once and before any work is done on them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-size // portion)), by)


def size_of(rows: DataFrame) -> int:
    return int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, block_seq, text, x0..y1, confidence of every line of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = {d: "\n".join(t for e, _, t in FIXTURE if e == d) for d, _, _ in FIXTURE}
    every = spread(docs.unionByName(spark.createDataFrame(list(extra.items()), "doc_id bigint, text string")), "doc_id", size_of(docs))
    row = F.col("n") % PAGE_LINES
    x0, y0 = (72 + 260 * (F.col("n") % 2)).cast("double"), (40 + 18 * row).cast("double")
    wide = F.least(6 * F.length("text"), F.lit(240)).cast("double")
    return every.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).select(
        "doc_id", F.floor(F.col("n") / PAGE_LINES).cast("int").alias("page_no"), F.col("n").alias("block_seq"), "text",
        x0.alias("x0"), y0.alias("y0"), (x0 + wide).alias("x1"), (y0 + 12).alias("y1"), (40 + F.length("text") % 60).cast("double").alias("confidence"),
    )


_VALUES = ", ".join(f"({d}, {n}, {quoted(t)})" for d, n, t in FIXTURE)
#: The same relation as common table expressions; a query goes on with ", name AS (...)" or SELECT.
LINES = f"""
    raw_lines AS (
        SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
        UNION ALL SELECT * FROM (VALUES {_VALUES}) AS f(doc_id, n, text)
    ),
    lines AS (
        SELECT doc_id, CAST(n // 40 AS INTEGER) AS page_no, CAST(n AS INTEGER) AS block_seq, text, CAST(72 + 260 * (n % 2) AS DOUBLE) AS x0, CAST(40 + 18 * (n % 40) AS DOUBLE) AS y0,
               CAST(72 + 260 * (n % 2) + least(6 * length(text), 240) AS DOUBLE) AS x1, CAST(52 + 18 * (n % 40) AS DOUBLE) AS y1, CAST(40 + length(text) % 60 AS DOUBLE) AS confidence
        FROM raw_lines
    )"""

WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
CJK = r"\x{3040}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}"
HAN = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
UNIT = "(%|‰|°C|°F|GPa|MPa|kPa|Pa|psi|bars?|kN/m2|kN/m²|kN|km/h|km|cm|mm|m/s|m|kg|g|t)"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze_sql(c: str) -> str:
    return strip_sql(f"regexp_replace({c}, '{WS}+', ' ', 'g')")


def matches(c: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({c}, {quoted(pattern)}{', ' + quoted(flags) if flags else ''})"


def measure_sql(t: str) -> str:
    return f"({matches(t, chr(92) + 'p{Nd}')} AND {matches(t, '(^|[^A-Za-z])' + UNIT + '([^A-Za-z]|$)', 'i')})"


def classify_sql(t: str) -> str:
    """Type of an OCR line with stripped text t and no font size."""
    sections = ", ".join(map(quoted, "abstract,acknowledgements,acknowledgment,appendix,background,case histories,case history,conclusion,conclusions,discussion,field data,introduction,list of symbols,literature review,method,methodology,nomenclature,notation,references,results,summary,testing".split(",")))
    numbered = " OR ".join(matches(t, p) for p in (rf"^\p{{Nd}}+[.、)）]{WS}+[^ ]", rf"^\p{{Nd}}+(\.\p{{Nd}}+)+[.、)）]?{WS}+[^ ]", rf"^[A-Z][.、)）]{WS}+"))
    return f"""CASE WHEN length({t}) = 0 THEN 'uncertain'
        WHEN {matches(t, '[=≈]')} OR {measure_sql(t)} THEN 'paragraph'
        WHEN length({t}) BETWEEN 4 AND 65 AND NOT {matches(t, '[.。?？!！:：；、…]$')} AND NOT {matches(f"replace(replace(replace({t}, '.', ''), '-', ''), ' ', '')", '^[0-9²³¹]+$')}
             AND ({numbered} OR ({matches(t, '[一-鿿㐀-䶿가-힯]')} AND length({t}) BETWEEN 3 AND 15)
                  OR {matches(squeeze_sql(t), '^[A-Z][A-Za-z]*( [A-Z][A-Za-z]*){1,5}$')} OR (lower({t}) IN ({sections}) AND {matches(t, '^[A-Z]')})) THEN 'heading'
        WHEN {matches(t, rf'^(\p{{Nd}}+[.、)]|[-*+.)]){WS}+')} THEN 'list' ELSE 'paragraph' END"""


PRIORITY_SQL = "CASE {t} WHEN 'title' THEN 0 WHEN 'heading' THEN 1 WHEN 'paragraph' THEN 2 WHEN 'list' THEN 2 WHEN 'table' THEN 3 WHEN 'figure' THEN 4 WHEN 'formula' THEN 4 WHEN 'uncertain' THEN 5 WHEN 'placeholder' THEN 6 WHEN 'footer' THEN 7 WHEN 'header' THEN 7 ELSE 9 END"
#: Lines with their type, after LINES.
TYPED = f", typed AS (SELECT *, {classify_sql('t')} AS type FROM (SELECT *, {strip_sql('text')} AS t FROM lines))"
#: Typed lines with their place in reading order.
ORDERED = f", ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y0 / 12, 0) * 12, x0, {PRIORITY_SQL.format(t='type')}, block_seq) AS pos FROM typed)"
