"""Reading order of blocks (doc_id, page_no, block_seq, type, x0..y1)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import priority

PAGE = ["doc_id", "page_no"]


def _default_keys() -> list[Column]:
    band = F.coalesce(F.bround(F.col("y0") / 12, 0) * 12, F.lit(0.0))
    return [band, F.coalesce("x0", F.lit(0.0)), priority(F.col("type")), F.col("block_seq")]


def default_order(blocks: DataFrame) -> DataFrame:
    """Adds pos: by bands of 12, then x, then type; blocks without a box come first. Halves round to even."""
    return blocks.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*_default_keys())))


def _gaps(blocks: DataFrame, width: float | Column) -> DataFrame:
    """Adds _c, the centre of a block that counts for columns, _k, its rank in the page, and _gap and _mid to the next.

    Blocks that don't count are kept, as a filter would have the type made a
    second time, once for each place that names it.
    """
    role = F.col("role") if "role" in blocks.columns else F.lit(None).cast("string")
    member = (F.col("x1") - F.col("x0") < width * 0.5) & ~F.col("type").isin("header", "footer") & (F.coalesce(role, F.lit("")) != "page_number")
    w = Window.partitionBy(*PAGE).orderBy(F.col("_c").asc_nulls_last(), "block_seq")
    ranked = blocks.withColumn("_c", F.when(member, (F.col("x0") + F.col("x1")) / 2.0)).withColumns({"_k": F.row_number().over(w), "_next": F.lead("_c").over(w)})
    return ranked.withColumns({"_w": F.when(F.col("_c").isNotNull(), width), "_gap": F.col("_next") - F.col("_c"), "_mid": (F.col("_c") + F.col("_next")) / 2.0}).drop("_next")


def _best() -> tuple[Column, Column, Column]:
    """Of a page's gaps the largest, the first of equals; its blocks that count; its width."""
    return F.max(F.when(F.col("_gap") > 0, F.struct("_gap", (-F.col("_k")).alias("first"), "_mid"))), F.count("_c"), F.max("_w")


def _split(best: Column, n: Column, width: Column) -> Column:
    # Centres left of the split are those up to the gap's left one.
    left = -best["first"]
    return F.when((n >= 6) & (best["_gap"] > width * 0.15) & (left >= 3) & (n - left >= 3), best["_mid"])


def column_split(blocks: DataFrame, width: float | Column) -> DataFrame:
    """(doc_id, page_no, split_x) of pages in two columns: the first largest gap between block centres.

    Narrow blocks that aren't headers or footers count; the gap must pass 15 %
    of the width and leave three centres on either side.
    """
    width = width if isinstance(width, Column) else F.lit(float(width))
    best, n, wide = _best()
    pages = _gaps(blocks, width).groupBy(*PAGE).agg(best.alias("best"), n.alias("n"), wide.alias("_w"))
    return pages.select(*PAGE, _split(F.col("best"), F.col("n"), F.col("_w")).alias("split_x")).where("split_x IS NOT NULL")


def two_column_order(blocks: DataFrame, width: float | Column) -> DataFrame:
    """Adds pos and split_x: column by column on pages in two columns, the default order elsewhere.

    The split is a window over the page, so blocks are made once.
    """
    width = width if isinstance(width, Column) else F.lit(float(width))
    page = Window.partitionBy(*PAGE)
    best = [c.over(page).alias(k) for k, c in zip(("_best", "_n", "_wide"), _best(), strict=True)]
    split = _gaps(blocks, width).select("*", *best).withColumn("split_x", _split(F.col("_best"), F.col("_n"), F.col("_wide")))
    side = F.when(F.col("x0").isNull(), 2.0).when((F.col("x0") + F.col("x1")) / 2.0 < F.col("split_x"), 0.0).otherwise(1.0)
    plain, whole = _default_keys(), F.col("split_x").isNull()
    keys = [F.when(whole, a.cast("double")).otherwise(b) for a, b in zip(plain, (side, F.col("y0"), F.col("x0")), strict=False)]
    made = split.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    made = made.withColumn("pos", F.row_number().over(page.orderBy("_k0", "_k1", "_k2", "block_seq")))
    return made.select(*[c for c in blocks.columns if c != "pos"], "split_x", "pos")


def projection_columns(blocks: DataFrame, width_of: str = "width") -> DataFrame:
    """Adds pos for pages of any number of columns, found as gaps in the smoothed projection on x.

    Pages are gathered once; the projection is one Arrow call for many pages,
    all else stays in the JVM.
    """
    @F.pandas_udf("array<double>")
    def cuts(x0: pd.Series, x1: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([projection_gaps(a, b, float(w)) if w and w > 0 else [] for a, b, w in zip(x0, x1, width, strict=True)])

    columns = blocks.columns
    boxed = F.filter("own", lambda b: b["x0"].isNotNull())
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("block_seq", F.struct(*columns).alias("b")))).alias("s"))
    pages = pages.withColumn("own", F.transform("s", lambda s: s["b"]))
    pages = pages.withColumn("cuts", cuts(F.transform(boxed, lambda b: b["x0"]), F.transform(boxed, lambda b: b["x1"]), F.get("own", 0)[width_of].cast("double")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    side = lambda b: F.when(b["x0"].isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: (b["x0"] + b["x1"]) / 2 >= c)))
    placed = F.sort_array(F.transform("own", lambda b: F.struct(side(b).alias("side"), zero(b["y0"]).alias("y"), zero(b["x0"]).alias("x"), b["block_seq"].alias("seq"), b.alias("b"))))
    out = pages.select(F.posexplode(placed).alias("p", "k"))
    return out.select(*[F.col(f"k.b.`{c}`").alias(c) for c in columns], (F.col("p") + 1).cast("bigint").alias("pos"))


def projection_gaps(x0, x1, width: float) -> list[float]:
    """Middles of the empty stretches of the x projection that are wide enough to part columns."""
    import numpy as np

    n = max(int(width), 1)
    steps = np.zeros(n + 1)
    lo, hi = np.clip(x0.astype(int), 0, None), np.minimum(x1.astype(int), int(width) - 1)
    some = hi >= lo
    np.add.at(steps, np.minimum(lo[some], n), 1)
    np.add.at(steps, hi[some] + 1, -1)
    sums = np.concatenate([[0], np.cumsum(np.cumsum(steps[:n]))])
    reach = max(int(width * 0.01), 2)
    a, b = np.maximum(np.arange(n) - reach, 0), np.minimum(np.arange(n) + reach + 1, n)
    smooth = (sums[b] - sums[a]) / (b - a)
    empty = smooth <= (max(smooth.max() * 0.03, 0.5) if smooth.max() > 0 else 0.5)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], empty, [False]]).astype(int)))
    found = []
    for start, end in zip(edge[::2], edge[1::2], strict=True):
        stop = end if end < n else n - 1
        if stop - start >= width * 0.06:
            found.append((start + stop) / 2)
    return found
