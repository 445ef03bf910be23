"""Tables: from lines of cells, from a ruled grid, from gaps between blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import escape_pipe, strip
from leafmill.operators.order import PAGE
from leafmill.sources.text import cells, is_table, markdown_table


def line_tables(lines: DataFrame) -> DataFrame:
    """(doc_id, n_rows, n_cols, is_table, markdown) of documents' lines (doc_id, block_seq, text) taken together."""
    own = lines.select("doc_id", "block_seq", strip(F.col("text")).alias("text")).where("text <> ''")
    docs = own.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_seq", "text"))), lambda x: x["text"]).alias("lines"))
    docs = docs.withColumn("rows", F.transform("lines", cells))
    return docs.select("doc_id", F.size("rows").alias("n_rows"), F.array_max(F.transform("rows", F.size)).alias("n_cols"), is_table(F.col("rows")).alias("is_table"), F.when(is_table(F.col("rows")), markdown_table(F.col("rows"))).alias("markdown"))


def chain(rows: DataFrame, keys: list[str], value: str, tolerance: Column, tie: str) -> DataFrame:
    """Adds cluster: a new one begins where a value is over tolerance above the value before it."""
    walk = Window.partitionBy(*keys).orderBy(value, tie)
    jump = F.coalesce((F.col(value) - F.lag(value).over(walk) > tolerance).cast("int"), F.lit(0))
    return rows.withColumn("_jump", jump).withColumn("cluster", F.sum("_jump").over(walk.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_jump")


def assign_cells(blocks: DataFrame, cells: DataFrame, least: float = 0.10) -> DataFrame:
    """Each block's cell (doc_id, page_no, r, c, x0..y1): the one over most of it, the first of equals; ``least`` of its area at least."""
    cells = cells.select(*PAGE, "r", "c", *[F.col(k).alias(f"c_{k}") for k in ("x0", "y0", "x1", "y1")])
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    side = lambda a: F.greatest(F.least(F.col(f"{a}1"), F.col(f"c_{a}1")) - F.greatest(F.col(f"{a}0"), F.col(f"c_{a}0")), F.lit(0.0))
    met = blocks.where(area > 0).join(cells, PAGE).withColumns({"_area": side("x") * side("y"), "_own": area})
    best = met.groupBy(*PAGE, "block_seq").agg(F.max(F.struct("_area", (-F.col("r")).alias("_r"), (-F.col("c")).alias("_c"), "_own", F.col("text").alias("text"))).alias("b"))
    kept = best.where(F.col("b._area") >= least * F.col("b._own"))
    return kept.select(*PAGE, "block_seq", (-F.col("b._r")).alias("r"), (-F.col("b._c")).alias("c"), strip(F.col("b.text")).alias("text"), (F.col("b._area") / F.col("b._own")).alias("ratio"))


def grid_cells(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """All cells with the texts assigned to them in block order; empty ones too."""
    own = assign_cells(blocks, cells)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_seq", "text"))), lambda x: x["text"]), " ")
    filled = own.groupBy(*PAGE, "r", "c").agg(text.alias("text"), F.sort_array(F.collect_list("block_seq")).alias("blocks"))
    return cells.join(filled, [*PAGE, "r", "c"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def group_rows(blocks: DataFrame) -> DataFrame:
    """Adds row: blocks by y and x join the row whose upper median centre is within 0.6 of the page's median height (4 at least).

    The median moves with the row, so this is a fold; one row of an array per page.
    """
    high = F.transform("own", lambda b: b["y1"] - b["y0"])
    median = F.get(F.sort_array(high), F.floor(F.size("own") / 2).cast("int"))
    order = F.struct("y0", "x0", "block_seq", "y1")
    pages = blocks.where(F.col("y0").isNotNull()).groupBy(*PAGE).agg(F.sort_array(F.collect_list(order)).alias("own"))
    pages = pages.withColumn("tolerance", F.greatest(F.lit(4.0), median * 0.6))
    kind = "struct<row:int,centres:array<double>,rows:array<int>>"

    def step(acc: Column, b: Column) -> Column:
        centre = (b["y0"] + b["y1"]) / 2
        middle = F.get(F.sort_array(acc["centres"]), F.floor(F.size(acc["centres"]) / 2).cast("int"))
        same = F.coalesce(F.abs(centre - middle) <= F.col("tolerance"), F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(row.alias("row"), F.when(same, F.concat(acc["centres"], F.array(centre))).otherwise(F.array(centre)).alias("centres"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(-1).alias("row"), F.array().cast("array<double>").alias("centres"), F.array().cast("array<int>").alias("rows")).cast(kind)
    placed = pages.select(*PAGE, "tolerance", F.explode(F.arrays_zip(F.transform("own", lambda b: b["block_seq"]).alias("block_seq"), F.aggregate("own", start, step)["rows"].alias("row"))).alias("z"))
    return blocks.join(placed.select(*PAGE, F.col("z.block_seq").alias("block_seq"), F.col("z.row").alias("row")), [*PAGE, "block_seq"])


def gap_tables(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, r, c, text, x0..y1) of tables seen in the alignment of blocks.

    Pages need four blocks, three rows, two column anchors and three rows of
    two blocks. Anchors are the means of chained left edges, cut to integers;
    a block goes to the anchor nearest its centre.
    """
    rows = group_rows(blocks)
    per_page = Window.partitionBy(*PAGE)
    per_row = Window.partitionBy(*PAGE, "row")
    high = rows.groupBy(*PAGE).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.col("y1") - F.col("y0"))).alias("hs"), (F.max("row") + 1).alias("n_rows"))
    high = high.select(*PAGE, "n", "n_rows", F.greatest(F.lit(6.0), F.get("hs", F.floor(F.col("n") / 2).cast("int")) * 0.5).alias("merge"))
    edges = rows.select(*PAGE, "x0").distinct().join(high, PAGE)
    anchors = chain(edges, PAGE, "x0", F.col("merge"), "x0").groupBy(*PAGE, F.col("cluster").alias("c")).agg(F.avg("x0").cast("int").cast("double").alias("anchor"))
    fit = anchors.groupBy(*PAGE).agg(F.count("*").alias("n_anchors")).where("n_anchors >= 2").join(high.where("n >= 4 AND n_rows >= 3"), PAGE).select(*PAGE)
    wide = rows.withColumn("together", F.count("*").over(per_row)).where("together >= 2")
    wide = wide.withColumn("r", F.dense_rank().over(per_page.orderBy("row")) - 1).withColumn("n_wide", F.max("r").over(per_page) + 1).where("n_wide >= 3").join(fit, PAGE)
    near = wide.join(anchors, PAGE).groupBy(*PAGE, "r", "block_seq", "x0", "y0", "x1", "y1", strip(F.col("text")).alias("text")).agg(F.min(F.struct(F.abs((F.col("x0") + F.col("x1")) / 2 - F.col("anchor")), "anchor", "c")).alias("best"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "block_seq", "text"))), lambda b: b["text"]), " ")
    filled = near.withColumn("c", F.col("best.c")).groupBy(*PAGE, "r", "c").agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    every = wide.select(*PAGE, "r").distinct().join(anchors, PAGE)
    out = every.join(filled, [*PAGE, "r", "c"], "left")
    return out.select(*PAGE, "r", "c", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("x0", "anchor").alias("x0"), *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("y0", "x1", "y1")])


def header_rows(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, is_header): the first row's share of capitals is over a half and half as much again as the others'."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    share = F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) / letters)
    mean = cells.groupBy(*PAGE).agg(F.avg(F.when(F.col("r") == 0, share)).alias("head"), F.avg(F.when(F.col("r") > 0, share)).alias("rest"))
    return mean.select(*PAGE, ((F.col("head") > 0.5) & (F.col("head") > F.col("rest") * 1.5)).alias("is_header"))


def markdown(cells: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, n_rows, n_cols): tables of cells as Markdown, the first row as head."""
    row = F.concat(F.lit("| "), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("c", "text"))), lambda x: strip(escape_pipe(x["text"]))), " | "), F.lit(" |"))
    rows = cells.groupBy(*PAGE, "r").agg(row.alias("line"), F.count("*").alias("n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("r", "line"))), lambda x: x["line"])
    pages = rows.groupBy(*PAGE).agg(lines.alias("lines"), F.max("n").alias("n_cols"), F.count("*").alias("n_rows"))
    rule = F.concat(F.lit("|"), F.array_join(F.array_repeat(F.lit(" --- "), F.col("n_cols").cast("int")), "|"), F.lit("|"))
    return pages.select(*PAGE, F.array_join(F.concat(F.slice("lines", 1, 1), F.array(rule), F.slice("lines", F.lit(2), F.size("lines"))), "\n").alias("text"), "n_rows", "n_cols")
