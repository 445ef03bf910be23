"""Layout of pages: zones, titles, lists, vertical text, formulas.

Blocks are (doc_id, page_no, block_seq, type, text, x0, y0, x1, y1,
confidence); a block without a box has null coordinates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import formula
from leafmill.functions.text import DIGIT, cjk_count, is_list_item, strip
from leafmill.operators.order import PAGE, two_column_order

_FIXED = ("figure", "table", "formula", "placeholder")


def looks_numeric(text: Column) -> Column:
    """At least half digits, dashes aside."""
    bare = F.translate(strip(text), "-—", "")
    digits = F.length(bare) - F.length(F.regexp_replace(bare, DIGIT, ""))
    return (digits > 0) & (digits * 2 >= F.length(bare))


def zones(blocks: DataFrame, height: float) -> DataFrame:
    """Headers, footers and page numbers by place; adds role. Width is held against the page's height."""
    kind, boxed = F.col("type"), F.col("y0").isNotNull()
    low = boxed & (F.col("y1") / height > 0.94)
    # Not one conjunction: what type and role share would be evaluated for every block, texts of no footer too.
    number = F.when(low & ((F.col("x1") - F.col("x0")) / height < 0.08), looks_numeric(F.col("text"))).otherwise(False)
    top = boxed & ~low & (F.col("y0") / height < 0.06) & ~kind.isin(*_FIXED, "title", "heading") & (F.length(strip(F.col("text"))) < 60)
    new = F.when(number | (low & ~kind.isin(*_FIXED)), "footer").when(top, "header").otherwise(kind)
    return blocks.withColumns({"type": new, "role": F.when(number, "page_number")})


def titles(blocks: DataFrame, width: float) -> DataFrame:
    """Centred headings and short paragraphs near the top become titles. Depth is held against the page's width."""
    centred = F.abs((F.col("x0") + F.col("x1")) / 2 - width / 2) / width < 0.15
    fits = centred & (F.col("y0") < width * 0.20) & ((F.col("type") == "heading") | ((F.col("type") == "paragraph") & (F.length(strip(F.col("text"))) <= 80)))
    return blocks.withColumn("type", F.when(fits, "title").otherwise(F.col("type")))


def consistent(blocks: DataFrame) -> DataFrame:
    """List items become lists, uncertain text of confidence 60 and more a paragraph."""
    kind = F.col("type")
    new = F.when(kind.isin("paragraph", "heading") & is_list_item(strip(F.col("text"))), "list").when((kind == "uncertain") & (F.col("confidence") >= 60), "paragraph")
    return blocks.withColumn("type", F.coalesce(new, kind))


def vertical(blocks: DataFrame) -> DataFrame:
    """Adds direction and, for vertical CJK text, a warning: tall boxes with over 40 % CJK characters."""
    wide, high, t = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), strip(F.col("text"))
    found = (wide > 0) & (high > 0) & ~((wide < 5) & (high < 5)) & (high > wide * 1.5) & (F.length(t) >= 2) & (cjk_count(t) * 10 > F.length(t) * 4)
    ratio = F.format_string("%.1f", high / F.greatest(wide, F.lit(1.0)))
    warning = F.concat(F.lit("Vertical CJK text, "), ratio, F.lit(" times taller than wide; OCR again in vertical mode may order characters better."))
    return blocks.withColumns({"direction": F.when(found, "vertical"), "direction_warning": F.when(found, warning)})


def isolation(blocks: DataFrame, height: float, of: Column | None = None) -> DataFrame:
    """Adds isolation, 0 to 1: a block's distances above and below against the page's mean gap; with ``of``, of those blocks alone.

    The block above is the last in order of y0 that ends over this one, the
    block below the first that begins under it.
    """
    page = Window.partitionBy(*PAGE)
    gap = F.col("y0") - F.lag("y1").over(page.orderBy(F.coalesce("y0", F.lit(0.0)), "block_seq"))
    boxes = F.collect_list(F.when(F.col("y0").isNotNull(), F.struct("y0", "block_seq", "y1"))).over(page)
    own = blocks.withColumn("_gap", gap).withColumns({"mean_gap": F.avg(F.when(F.col("_gap") > 0, F.col("_gap"))).over(page), "boxes": boxes})
    above = F.array_max(F.filter("boxes", lambda b: b["y1"] < F.col("y0")))["y1"]
    below = F.array_min(F.filter("boxes", lambda b: b["y0"] > F.col("y1")))["y0"]
    some = F.lit(True) if of is None else of
    own = own.withColumns({"_above": F.when(some, above), "_below": F.when(some, below)})
    above, below = F.col("_above"), F.col("_below")
    above_gap = F.when(above > 0, F.col("y0") - above).otherwise(F.col("y0"))
    below_gap = F.when(below < height, below - F.col("y1")).otherwise(height - F.col("y1"))
    share = lambda g: F.least(g / F.col("mean_gap"), F.lit(3.0))
    score = F.when(F.col("y0").isNull() | ~some, None).when(F.col("mean_gap").isNull(), 0.0).otherwise((share(above_gap) + share(below_gap)) / 6.0)
    return own.withColumn("isolation", score).drop("boxes", "mean_gap", "_gap", "_above", "_below")


def formulas(blocks: DataFrame, height: float) -> DataFrame:
    """Display formulas by their text, or by weaker text and isolation."""
    t = strip(F.col("text"))
    open_to = F.col("type").isin("paragraph", "uncertain", "heading") & F.col("y0").isNotNull() & (F.length(t) > 0) & ~formula.is_prose(t) & ~formula.is_measure(t)
    # Only what is open to be a formula is scored; most lines are prose, which their first words tell.
    scored = isolation(blocks.withColumn("_o", F.coalesce(open_to, F.lit(False))), height, F.col("_o")).withColumns({"_m": F.when(F.col("_o"), formula.math_score(t)), "_f": F.when(F.col("_o"), formula.fragment_score(t))})
    strong = (F.col("_f") >= 0.6) | (F.col("_m") >= 0.45) | ((F.col("_m") >= 0.25) & (F.col("isolation") >= 0.30))
    return scored.withColumn("type", F.when(F.col("_o") & strong, "formula").otherwise(F.col("type"))).drop("_m", "_f", "_o", "isolation")


def enhance(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """All layout steps in their order, formulas first; adds role, direction and pos."""
    steps = vertical(consistent(titles(zones(formulas(blocks, height), height), width)))
    return two_column_order(steps, width)


def page_summary(blocks: DataFrame) -> DataFrame:
    has = lambda kind: F.bool_or(F.col("type") == kind).alias(f"has_{kind}s")
    return blocks.groupBy(*PAGE).agg(F.count("*").alias("block_count"), *map(has, ("table", "figure", "header", "footer")), F.sum(F.length("text")).alias("text_length"))
