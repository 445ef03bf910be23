"""Chart items, axes and calibrations.

Chart items are (doc_id, seq, item_type, panel_id, class, class_candidates,
start_depth, end_depth, depth, depth_tolerance, color); calibrations are
points (key, pixel, value) or arrays of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.chart import is_nice_log_tick, on_line, parse_tick
from leafmill.functions.text import squeeze, strip


def merge_intervals(items: DataFrame, keys: Sequence[str] = ("panel_id", "class", "color"), slack: float = 0.5) -> DataFrame:
    """Intervals of equal keys that overlap or lie within ``slack``, joined; the tolerance is the keys' largest."""
    order = Window.partitionBy(*keys).orderBy("start_depth", "end_depth")
    reach = F.max("end_depth").over(order.rowsBetween(Window.unboundedPreceding, -1))
    jump = F.coalesce((F.col("start_depth") > reach + slack).cast("int"), F.lit(0))
    marked = items.withColumns({"_jump": jump, "_tol": F.max(F.coalesce("depth_tolerance", F.lit(0.0))).over(Window.partitionBy(*keys))})
    marked = marked.withColumn("_part", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy(*keys, "_part").agg(F.min("start_depth").alias("start_depth"), F.max("end_depth").alias("end_depth"), F.max("_tol").alias("depth_tolerance"))
    return merged.drop("_part")


def dedup_points(items: DataFrame, keys: Sequence[str] = ("panel_id", "class", "color"), seq: str = "seq") -> DataFrame:
    """The first point of those with equal keys and equal depth to the nearest even-rounded whole."""
    order = Window.partitionBy(*keys, F.bround(F.coalesce("depth", F.lit(0.0)), 0)).orderBy(seq)
    return items.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def deduplicate(items: DataFrame, keys: Sequence[str] = ("doc_id", "panel_id", "class", "color")) -> DataFrame:
    """Merged intervals and first points of mixed chart items."""
    bars = merge_intervals(items.where("item_type = 'interval'"), keys).withColumns({"item_type": F.lit("interval"), "start_depth": F.bround("start_depth", 1), "end_depth": F.bround("end_depth", 1)})
    return bars.unionByName(dedup_points(items.where("item_type = 'point'"), keys), allowMissingColumns=True)


def regression(points: DataFrame, keys: Sequence[str], x: str = "pixel", y: str = "value") -> DataFrame:
    """(keys, n, slope, intercept, r_squared, calibrated): least squares from sums, so that it combines before the shuffle.

    A constant y has an r_squared of 0; fewer than two points, or one x, give no line.
    """
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = points.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"), F.sum(b * b).alias("syy"))
    n = F.col("n").cast("double")
    vx, vy, co = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy"), n * F.col("sxy") - F.col("sx") * F.col("sy")
    slope = co / F.nullif(vx, F.lit(0.0))
    out = s.withColumns({"slope": slope, "intercept": (F.col("sy") - slope * F.col("sx")) / n, "r_squared": F.when(vx == 0, None).when(vy == 0, 0.0).otherwise(co * co / F.nullif(vx * vy, F.lit(0.0)))})
    return out.select(*keys, "n", "slope", "intercept", "r_squared", F.coalesce(F.col("r_squared") > 0.85, F.lit(False)).alias("calibrated"))


def log_scale(points: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", limit: float = 0.15) -> DataFrame:
    """(keys, log_scale): ratios of successive values vary less than their differences, and by under ``limit``.

    A mean difference of 0 or less counts as infinitely varied, so falling
    values with nearly constant ratios are logarithmic too.
    """
    walk = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(walk)
    steps = points.select(*keys, F.col(value).alias("v"), (F.col(value) / F.when(before != 0, before)).alias("ratio"), (F.col(value) - before).alias("diff"))
    spread = lambda c: F.when(F.avg(c) > 0, F.stddev_pop(c) / F.avg(c)).otherwise(F.lit(float("inf")))
    m = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), spread("ratio").alias("by_ratio"), spread("diff").alias("by_diff"))
    return m.select(*keys, ((F.col("n") >= 3) & (F.col("low") > 0) & (F.col("by_ratio") < F.col("by_diff")) & (F.col("by_ratio") < limit)).alias("log_scale"))


def interpolate(pixel: Column, points: Column) -> Column:
    """Piecewise linear through points (an array of pixel, value sorted by pixel), extended at both ends; one point is constant."""
    last = F.size(points)
    low, high = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    # The first segment whose right end isn't left of the pixel; the outer ones reach on.
    right = F.size(F.filter(points, lambda p: p["pixel"] < pixel)) + 1
    i = F.greatest(F.lit(2), F.least(last, F.when(pixel <= low["pixel"], 2).when(pixel >= high["pixel"], last).otherwise(right)))
    a, b = F.try_element_at(points, i - 1), F.try_element_at(points, i)
    return F.when(last == 0, None).when(last == 1, low["value"]).otherwise(on_line(pixel, a["pixel"], a["value"], b["pixel"], b["value"]))


def pixel_to_data(pixel: Column, points: Column, calibrated: Column, size: Column, low: Column, high: Column) -> Column:
    """By the calibration if there is one, else linear over the panel."""
    plain = low + pixel / F.greatest(size, F.lit(1)) * (high - low)
    return F.when(F.coalesce(calibrated & (F.size(points) > 0), F.lit(False)), interpolate(pixel, points)).otherwise(plain)


def pixel_to_data_log(pixel: Column, points: Column, calibrated: Column, size: Column, low: Column, high: Column) -> Column:
    """The same in powers of ten; with fewer than two points as pixel_to_data."""
    logs = F.transform(points, lambda p: F.struct(p["pixel"].alias("pixel"), F.log10(F.greatest(p["value"], F.lit(1e-10))).alias("value")))
    return F.when(F.coalesce(F.size(points) >= 2, F.lit(False)), F.pow(F.lit(10.0), interpolate(pixel, logs))).otherwise(pixel_to_data(pixel, points, calibrated, size, low, high))


def tick_lines(ticks: DataFrame, keys: Sequence[str], log_axis: bool) -> DataFrame:
    """(keys, kind, a, b) of axes from read ticks (value, px, conf).

    Sure ticks of fitting values are taken; of those within 14 of one another
    the one nearest a whole number stands; a logarithmic axis is anchored on
    the tick 1.
    """
    value, whole = F.col("value"), F.abs(F.col("value") - F.bround("value", 0))
    kept = ticks.where((F.col("conf") >= 40) & (is_nice_log_tick(value) if log_axis else value.between(-0.6, 1.6)))
    rows = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("px", value.alias("value"), whole.alias("off")))).alias("own"))
    kind = "array<struct<px:double,value:double,off:double>>"

    def step(done: Column, t: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        near = F.coalesce(F.abs(t["px"] - last["px"]) <= 14, F.lit(False))
        front = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(near & (t["off"] < last["off"]), F.concat(front, F.array(t))).when(near, done).otherwise(F.concat(done, F.array(t))).cast(kind)

    chosen = rows.select(*keys, F.explode(F.aggregate(F.col("own").cast(kind), F.array().cast(kind), step)).alias("t")).select(*keys, "t.px", "t.value")
    fit = regression(chosen.withColumn("y", F.log10("value") if log_axis else F.col("value")), keys, "px", "y").where("n >= 2 AND slope IS NOT NULL")
    if not log_axis:
        return fit.select(*keys, F.lit("linear").alias("kind"), F.col("slope").alias("a"), F.col("intercept").alias("b"))
    one = chosen.where(F.abs(F.col("value") - 1.0) < 1e-6).groupBy(*keys).agg(F.min("px").alias("one"))
    fit = fit.where("slope > 1e-6").join(one, list(keys), "left")
    return fit.select(*keys, F.lit("log").alias("kind"), F.col("slope").alias("a"), F.coalesce(-F.col("slope") * F.col("one"), F.col("intercept")).alias("b"))


def margin_labels(blocks: DataFrame, panels: DataFrame, side: str = "left") -> DataFrame:
    """Numbers written beside or below panels (panel_id, px0..py1, margin): panel, place along the axis, value, text."""
    met = blocks.join(panels, ["doc_id", "page_no"]).withColumn("value", parse_tick(F.col("text"))).where("value IS NOT NULL AND x0 IS NOT NULL")
    if side == "below":
        fits = "y0 >= py1 - 5 AND y0 <= py1 + margin * 3 AND x0 >= px0 - 20 AND x1 <= px1 + 20"
        place = (F.col("x0") + F.col("x1")) / 2 - F.col("px0")
    else:
        near = "x1 <= px0 + margin * 2" if side == "left" else "x0 >= px1 - margin * 2"
        fits, place = f"y0 >= py0 - 10 AND y1 <= py1 + 10 AND {near}", (F.col("y0") + F.col("y1")) / 2 - F.col("py0")
    return met.where(fits).select("doc_id", "page_no", "panel_id", "block_seq", place.alias("place"), "value", strip(F.col("text")).alias("text"))


def pair_ticks(ticks: DataFrame, labels: DataFrame, keys: Sequence[str], limit: float = 25) -> DataFrame:
    """(keys, pixel, value): ticks in order each take the nearest label that is still free, nearer than ``limit``.

    Ticks are (keys, pixel), labels (keys, seq, place, value). What one takes
    another can't have, so this is a fold, by panel.
    """
    wait = F.sort_array(F.collect_list("pixel"))
    own = ticks.withColumn("pixel", F.col("pixel").cast("double")).groupBy(*keys).agg(wait.alias("ticks"))
    offer = labels.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", F.col("place").cast("double").alias("place"), F.col("value").cast("double").alias("value")))).alias("labels"))
    kind = "struct<free:array<struct<seq:bigint,place:double,value:double>>,pairs:array<struct<pixel:double,value:double>>>"

    def step(acc: Column, t: Column) -> Column:
        best = F.array_min(F.transform(acc["free"], lambda x: F.struct(F.abs(x["place"] - t).alias("d"), x["seq"].alias("seq"), x["value"].alias("value"))))
        takes = F.coalesce(best["d"] < limit, F.lit(False))
        free = F.when(takes, F.filter(acc["free"], lambda x: x["seq"] != best["seq"])).otherwise(acc["free"])
        pairs = F.when(takes, F.concat(acc["pairs"], F.array(F.struct(t.alias("pixel"), best["value"].alias("value"))))).otherwise(acc["pairs"])
        return F.struct(free.alias("free"), pairs.alias("pairs")).cast(kind)

    start = lambda labels: F.struct(labels.alias("free"), F.array().cast("array<struct<pixel:double,value:double>>").alias("pairs")).cast(kind)
    met = own.join(offer, list(keys))
    return met.select(*keys, F.explode(F.aggregate("ticks", start(F.col("labels")), step)["pairs"]).alias("p")).select(*keys, "p.pixel", "p.value")


def second_axis(primary: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, is_dual): the second axis's values are others than the first's, and so is their range."""
    values = lambda d, n: d.groupBy(*keys).agg(F.collect_set("value").alias(n))
    met = values(second, "s").join(values(primary, "p"), list(keys), "left")
    few = F.size(F.array_intersect("p", "s")) > 0.5 * F.least(F.size("p"), F.size("s"))
    near = lambda a, b: F.abs(a - b) < 0.01 * F.greatest(F.abs(a), F.lit(1.0))
    same = near(F.array_min("p"), F.array_min("s")) & near(F.array_max("p"), F.array_max("s"))
    return met.select(*keys, F.coalesce(~(few | same), F.lit(True)).alias("is_dual"))


def nearest_class(points: DataFrame, centres: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points (keys, point_id, px) with the class of the nearest centre (keys, seq, x, class).

    The second nearest is a candidate too within three quarters of the median
    step between centres.
    """
    ordered = centres.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "x", "class"))).alias("own"), F.sort_array(F.collect_list("x")).alias("xs"))
    gaps = F.filter(F.transform(F.sequence(F.lit(1), F.size("xs") - 1), lambda i: F.get("xs", i) - F.get("xs", i - 1)), lambda g: g > 0)
    ordered = ordered.withColumn("gaps", F.when(F.size("xs") >= 2, F.sort_array(gaps)))
    n = F.size("gaps")
    half = F.floor(n / 2).cast("int")
    step = F.when(n > 0, F.when(n % 2 == 1, F.get("gaps", half)).otherwise((F.get("gaps", half - 1) + F.get("gaps", half)) / 2))
    met = points.join(ordered.withColumn("step", step), list(keys))
    near = F.array_sort(F.transform("own", lambda c: F.struct(F.abs(c["x"] - F.col("px")).alias("d"), c["seq"].alias("seq"), c["class"].alias("class"))))
    met = met.withColumn("near", near)
    first, second = F.get("near", 0), F.get("near", 1)
    both = F.coalesce((F.col("step") > 0) & (second["d"] <= F.col("step") * 0.75), F.lit(False))
    return met.select(*keys, "point_id", first["class"].alias("class"), F.when(both, F.array(first["class"], second["class"])).otherwise(F.array(first["class"])).alias("class_candidates"))


def containing_class(points: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points (keys, point_id, depth) with the class of the first interval around them, else of the nearest middle."""
    met = points.join(intervals.select(*keys, "seq", "class", "start_depth", "end_depth"), list(keys))
    inside = F.col("depth").between(F.col("start_depth"), F.col("end_depth"))
    away = F.abs(F.col("depth") - (F.col("start_depth") + F.col("end_depth")) / 2)
    best = F.min(F.struct(F.when(inside, 0).otherwise(1).alias("out"), F.when(inside, 0.0).otherwise(away).alias("away"), "seq", "class"))
    return met.groupBy(*keys, "point_id").agg(best.alias("b")).select(*keys, "point_id", F.col("b.class").alias("class"))


def anchor_candidates(points: DataFrame, anchors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The three zones (anchors: keys, zone, x, y) nearest each point (keys, point_id, px, py)."""
    listed = anchors.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("zone", "x", "y"))).alias("own"))
    near = F.array_sort(F.transform("own", lambda a: F.struct(F.hypot(F.col("px") - a["x"], F.col("py") - a["y"]).alias("d"), a["zone"].alias("zone"))))
    zones = F.transform(F.slice(near, 1, 3), lambda s: s["zone"])
    return points.join(listed, list(keys)).select(*keys, "point_id", zones.alias("class_candidates")).withColumn("class", F.get("class_candidates", 0))


def panel_labels(blocks: DataFrame, panels: DataFrame) -> DataFrame:
    """(doc_id, page_no, panel_id, x_label, y_label, caption): the nearest texts below, left of, above or below a panel."""
    met = blocks.where("x0 IS NOT NULL").join(panels, ["doc_id", "page_no"])
    w, h = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    across = lambda k: (cx > F.col("px0") - w * k) & (cx < F.col("px1") + w * k)
    under = (F.col("y0") > F.col("py1")) & (F.col("y1") < F.col("py1") + h * 0.3)
    left = (F.col("x1") < F.col("px0")) & (cy > F.col("py0") - h * 0.2) & (cy < F.col("py1") + h * 0.2)
    about = across(0.1) & (((F.col("y1") < F.col("py0")) & (F.col("y0") > F.col("py0") - h * 0.3)) | under)
    first = lambda cond, key: F.min(F.when(cond, F.struct(key.alias("k"), "block_seq", "text")))["text"]
    return met.groupBy("doc_id", "page_no", "panel_id").agg(first(across(0.2) & under, F.col("y0")).alias("x_label"), first(left, -F.col("x1")).alias("y_label"), first(about, cy).alias("caption"))


def structure_labels(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """(doc_id, page_no, panel_id, x_label, y_label, caption, annotations) of chart regions, legends and captions left out of labels."""
    met = blocks.where("x0 IS NOT NULL").join(regions, ["doc_id", "page_no"]).withColumn("s", squeeze(F.col("text")))
    w, h, s = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0"), F.col("s")
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    legend = s.rlike(r"^[0-9]+[.)]") | s.rlike(r"(?i)^.{0,12}?(?:fic|fig|figure)\.?\s*[0-9]")
    below = ~legend & (F.length("s") >= 4) & (F.col("y0") > F.col("py1")) & (F.col("y0") <= F.col("py1") + F.greatest(h * 0.25, F.lit(40.0))) & cx.between(F.col("px0") + w * 0.15, F.col("px1") - w * 0.15)
    beside = ~legend & (F.length("s") >= 3) & (F.col("x1") < F.col("px0") + w * 0.05) & cy.between(F.col("py0") - h * 0.05, F.col("py1") + h * 0.05)
    caption = (F.col("y0") >= F.col("py1")) & (F.col("y0") <= F.col("py1") + F.greatest(h * 0.6, F.lit(90.0))) & F.substring("s", 1, 60).rlike(r"(?i)(?:fic|fig|figure)\.?\s*[0-9]")
    t = strip(F.col("text"))
    inside = (F.length(t).between(1, 14)) & (F.col("x0") >= F.col("px0")) & (F.col("y0") >= F.col("py0")) & (F.col("x1") <= F.col("px1")) & (F.col("y1") <= F.col("py1"))
    least = lambda cond, *keys: F.coalesce(F.min(F.when(cond, F.struct(*[k.alias(f"k{i}") for i, k in enumerate(keys)], "block_seq", "s")))["s"], F.lit(""))
    notes = F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(inside, F.struct("block_seq", t.alias("t"))))), lambda x: x["t"]))
    return met.groupBy("doc_id", "page_no", "panel_id").agg(
        least(below, F.col("y0") - F.col("py1"), -F.length("s")).alias("x_label"),
        least(beside, -F.length("s"), F.col("x1")).alias("y_label"),
        least(caption, F.lit(0)).alias("caption"),
        notes.alias("annotations"),
    )


def attach_to_figures(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """Chart items of a page go to its first figure; pages without one get a figure block at the end."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("seq", "item_type", "panel_id", "class", "class_candidates", "start_depth", "end_depth", "depth", "depth_tolerance"))), lambda x: x.dropFields("seq"))
    data = items.groupBy("doc_id", "page_no").agg(listed.alias("items"))
    first = blocks.where("type = 'figure'").groupBy("doc_id", "page_no").agg(F.min("block_seq").alias("block_seq"))
    target = data.join(first, ["doc_id", "page_no"], "left")
    last = blocks.groupBy("doc_id", "page_no").agg((F.max("block_seq") + 1).alias("after"))
    own = target.where("block_seq IS NOT NULL").withColumnRenamed("items", "chart")
    made = target.where("block_seq IS NULL").drop("block_seq").join(last, ["doc_id", "page_no"], "left")
    made = made.select("doc_id", "page_no", F.coalesce("after", F.lit(0)).alias("block_seq"), F.lit("figure").alias("type"), F.lit("").alias("text"), F.col("items").alias("chart"))
    return blocks.join(own, ["doc_id", "page_no", "block_seq"], "left").unionByName(made, allowMissingColumns=True)
