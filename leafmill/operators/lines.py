"""Lines from spans of native pages and from OCR words; paragraphs from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import cjk_count, classify_ocr, classify_text, normalize, strip
from leafmill.operators.order import PAGE


def assemble_spans(spans: DataFrame) -> DataFrame:
    """Lines of positioned spans (doc_id, page_no, span_seq, x, y, font_size, text).

    Spans are taken by bands of 4 in y, then by x; a span over 4 away from the
    one before begins a line.
    """
    walk = Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y") / 4, 0) * 4, "x", "span_seq")
    jump = F.coalesce((F.abs(F.col("y") - F.lag("y").over(walk)) > 4).cast("int"), F.lit(0))
    marked = spans.withColumn("jump", jump).withColumn("line", F.sum("jump").over(walk.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.sort_array(F.collect_list(F.struct("x", "span_seq", "text"))), lambda s: s["text"])
    line = marked.groupBy(*PAGE, "line").agg(strip(F.array_join(words, " ")).alias("text"), F.max("font_size").alias("font_size"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    tall = F.greatest(F.col("font_size"), F.lit(8.0))
    kind = F.when((F.col("font_size") >= 14) & (F.length("text") <= 120), "heading").otherwise(classify_text(F.col("text"), F.lit(1)))
    return line.where("text <> ''").select(
        *PAGE, F.col("line").cast("int").alias("block_seq"), kind.alias("type"), "text", "x0", "y0",
        (F.col("x0") + F.greatest(F.length("text") * tall * 0.55, F.lit(1.0))).alias("x1"), (F.col("y0") + tall).alias("y1"), F.lit(100.0).alias("confidence"),
    )


def ocr_lines(words: DataFrame, min_confidence: float = 45.0, split: bool = True) -> DataFrame:
    """Segments of OCR lines from words (doc_id, page_no, word_seq, block_num, par_num, line_num, left, top, width, height, conf, text).

    Blank and unsure words go; a gap over a tenth of the line's width, and over
    15, parts a line. Without ``split`` lines stay whole, words keep their
    order and every line is a paragraph.
    """
    line = [*PAGE, "block_num", "par_num", "line_num"]
    kept = words.where((strip(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= min_confidence)).withColumn("right", F.col("left") + F.col("width"))
    if split:
        by_left = Window.partitionBy(*line).orderBy("left", "word_seq")
        whole = by_left.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        wide = F.last("right").over(whole) - F.first("left").over(whole)
        jump = F.coalesce((F.col("left") - F.lag("right").over(by_left) > F.greatest(wide * 0.10, F.lit(15.0))).cast("int"), F.lit(0))
        marked = kept.withColumn("jump", jump).withColumn("seg", F.sum("jump").over(by_left.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        order = ("left", "word_seq", "text")
    else:
        marked, order = kept.withColumn("seg", F.lit(0)), ("word_seq", "left", "text")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda s: strip(s["text"])), " ")
    made = marked.groupBy(*line, "seg").agg(
        text.alias("text"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max("right").alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
        F.avg("conf").alias("confidence"), F.count("*").alias("n_words"), F.min("word_seq").alias("first_word"),
    )
    made = made.withColumn("text", normalize(F.col("text")))
    return made.withColumn("type", classify_ocr(F.col("text")) if split else F.lit("paragraph"))


def best_pass(blocks: DataFrame, passes: list[int]) -> DataFrame:
    """Of several OCR passes (doc_id, psm, confidence) the one of best mean confidence; the first of equals, none at 0."""
    order = F.array_position(F.array(*map(F.lit, passes)), F.col("psm"))
    mean = blocks.groupBy("doc_id", "psm").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("mean")).where("mean > 0")
    return mean.groupBy("doc_id").agg(F.max(F.struct("mean", (-order).alias("early"), "psm")).alias("best")).select("doc_id", F.col("best.psm").alias("psm"), F.col("best.mean").alias("mean"))


_RANK = {"title": 0, "heading": 1, "list": 2, "paragraph": 3, "uncertain": 4}
_BLOCK = ("type", "text", "x0", "y0", "x1", "y1", "confidence")


def _rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in _RANK.items() for x in p]), kind), F.lit(9))


def _cjk(b: Column) -> Column:
    """is_cjk of a folded block; its count of CJK characters is carried, so most texts aren't looked at."""
    return (b["cjk"] > 0) & (b["cjk"] * 10 > F.length(strip(b["text"])) * 3)


def _merged(a: Column, b: Column) -> Column:
    """Two blocks as one: the mean of the two confidences, not of all lines'."""
    gap = F.when(_cjk(a) & _cjk(b), "").otherwise(" ")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return F.struct(
        F.when(a["rank"] <= b["rank"], a["type"]).otherwise(b["type"]).alias("type"),
        F.concat(a["text"], gap, b["text"]).alias("text"),
        *[F.least(a[k], b[k]).alias(k) for k in ("x0", "y0")],
        *[F.greatest(a[k], b[k]).alias(k) for k in ("x1", "y1")],
        ((zero(a["confidence"]) + zero(b["confidence"])) / 2).alias("confidence"),
        F.least(a["rank"], b["rank"]).alias("rank"),
        (a["cjk"] + b["cjk"]).alias("cjk"),
    )


def _same_text(a: Column, b: Column) -> Column:
    gap = b["y0"] - a["y1"]
    near = (a["type"] == "paragraph") & (b["type"] == "paragraph") & gap.between(0, 12) & (F.abs(a["x0"] - b["x0"]) <= 16)
    return near & ~((gap > 8) & _cjk(a) & strip(a["text"]).rlike("[。！？]$"))


def _same_ocr(a: Column, b: Column) -> Column:
    gap = b["y0"] - a["y1"]
    high = ((a["y1"] - a["y0"]) + (b["y1"] - b["y0"])) / 2
    return (gap >= 0) & (gap <= F.greatest(F.lit(10.0), high * 1.6)) & (F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]) > 0)


def merge_paragraphs(blocks: DataFrame, ocr: bool = False) -> DataFrame:
    """Adjacent lines of a page as paragraphs, each line held against what was merged so far.

    Native text goes in block order and merges paragraphs; OCR lines go by
    place and merge whatever their type. A fold inside one row per page: the
    open paragraph is held apart from those that are done.
    """
    same = _same_ocr if ocr else _same_text
    keys = [F.coalesce("y0", F.lit(0.0)), F.coalesce("x0", F.lit(0.0)), F.col("block_seq")] if ocr else [F.col("block_seq")]
    own = F.struct(*_BLOCK, _rank(F.col("type")).alias("rank"), F.coalesce(cjk_count(F.col("text")), F.lit(0)).alias("cjk"))
    sort = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], own.alias("b"))
    pages = blocks.groupBy(*PAGE).agg(F.transform(F.sort_array(F.collect_list(sort)), lambda s: s["b"]).alias("own"))
    block = "struct<type:string,text:string,x0:double,y0:double,x1:double,y1:double,confidence:double,rank:int,cjk:int>"
    kind = f"struct<done:array<{block}>,open:{block}>"

    def step(acc: Column, b: Column) -> Column:
        joins = F.coalesce(same(acc["open"], b), F.lit(False))
        state = lambda done, last: F.struct(done.alias("done"), last.alias("open")).cast(kind)
        closed = F.concat(acc["done"], F.array(acc["open"]))
        return F.when(joins, state(acc["done"], _merged(acc["open"], b))).when(acc["open"].isNull(), state(acc["done"], b)).otherwise(state(closed, b))

    start = F.struct(F.array().cast(f"array<{block}>").alias("done"), F.lit(None).cast(block).alias("open")).cast(kind)
    # Blocks enter in the accumulator's own shape.
    folded = pages.select(*PAGE, F.aggregate(F.col("own").cast(f"array<{block}>"), start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"]))).alias("done"))
    return folded.select(*PAGE, F.posexplode("done").alias("block_seq", "b")).select(*PAGE, "block_seq", *[f"b.{k}" for k in _BLOCK])
