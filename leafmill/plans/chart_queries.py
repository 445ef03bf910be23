"""Queries on charts: intervals, points, axes, ticks, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import chart as C
from leafmill.operators import charts
from leafmill.plans.relations import LINES, lines, squeeze_sql, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _cents(name):
    return F.round(F.col(name) * 100).cast("bigint").alias(f"{name}_cents")


_ITEMS = "SELECT user_id AS panel, event_type AS class, event_id, value AS s, value + event_id % 7 / 4.0 AS e, event_id % 3 / 4.0 AS tol FROM events"


@query(f"""
    WITH i AS ({_ITEMS}), m AS (SELECT *, max(e) OVER (PARTITION BY panel, class ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, max(tol) OVER (PARTITION BY panel, class) AS t FROM i),
    p AS (SELECT *, sum(CASE WHEN s > reach + 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY panel, class ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS part FROM m)
    SELECT panel AS panel_id, class, CAST(round(min(s) * 100) AS BIGINT) AS start_depth_cents, CAST(round(max(e) * 100) AS BIGINT) AS end_depth_cents, CAST(round(max(t) * 100) AS BIGINT) AS depth_tolerance_cents FROM p GROUP BY panel, class, part""")
def merge_intervals(spark, sf_dir):
    items = table(spark, sf_dir, "events").selectExpr("user_id AS panel_id", "event_type AS class", "value AS start_depth", "value + event_id % 7 / 4.0D AS end_depth", "event_id % 3 / 4.0D AS depth_tolerance")
    return charts.merge_intervals(items, ("panel_id", "class")).select("panel_id", "class", *map(_cents, ("start_depth", "end_depth", "depth_tolerance")))


@query("""
    SELECT event_id, panel_id, class FROM (SELECT event_id, user_id AS panel_id, event_type AS class, row_number() OVER (PARTITION BY user_id, event_type, round_even(value, 0) ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def dedup_points(spark, sf_dir):
    items = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS panel_id", "event_type AS class", "value AS depth")
    return charts.dedup_points(items, ("panel_id", "class"), "event_id").select("event_id", "panel_id", "class")


_POINTS = "SELECT user_id, CAST(event_id % 100 AS DOUBLE) AS x, CAST(round(value * 100) AS DOUBLE) AS y FROM events"


@query(f"""
    WITH p AS ({_POINTS}), s AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM p GROUP BY 1),
    v AS (SELECT *, n * sxx - sx * sx AS vx, n * syy - sy * sy AS vy, n * sxy - sx * sy AS co FROM s)
    SELECT user_id, CAST(n AS BIGINT) AS n, CAST(floor(co / nullif(vx, 0) * 10000 + 0.5) AS BIGINT) AS slope_e4, CAST(floor(CASE WHEN vx = 0 THEN NULL WHEN vy = 0 THEN 0 ELSE co * co / (vx * vy) END * 1000000 + 0.5) AS BIGINT) AS r2_ppm FROM v""")
def axis_regression(spark, sf_dir):
    points = table(spark, sf_dir, "events").selectExpr("user_id", "CAST(event_id % 100 AS DOUBLE) AS pixel", "CAST(round(value * 100) AS DOUBLE) AS value")
    fit = charts.regression(points, ["user_id"])
    return fit.select("user_id", "n", F.floor(F.col("slope") * 10000 + 0.5).alias("slope_e4"), F.floor(F.col("r_squared") * 1000000 + 0.5).alias("r2_ppm"))


_SERIES = """SELECT event_id % 500 AS k, event_type, event_id, CASE WHEN event_id % 500 % 2 = 0 THEN value ELSE pow(2.0, event_id // 500 % 20) + 0.001 * (event_id % 3) END AS v FROM events"""


@query(f"""
    WITH p AS ({_SERIES}), s AS (SELECT k, v, v / nullif(lag(v) OVER w, 0) AS r, v - lag(v) OVER w AS d FROM p WINDOW w AS (PARTITION BY k ORDER BY event_id)),
    m AS (SELECT k, count(*) AS n, min(v) AS low, CASE WHEN avg(r) > 0 THEN stddev_pop(r) / avg(r) ELSE 'inf'::DOUBLE END AS br, CASE WHEN avg(d) > 0 THEN stddev_pop(d) / avg(d) ELSE 'inf'::DOUBLE END AS bd FROM s GROUP BY 1)
    SELECT k, n >= 3 AND low > 0 AND br < bd AND br < 0.15 AS log_scale FROM m""")
def log_scale_detect(spark, sf_dir):
    points = table(spark, sf_dir, "events").selectExpr("event_id % 500 AS k", "event_id", "CASE WHEN event_id % 500 % 2 = 0 THEN value ELSE pow(2.0D, event_id div 500 % 20) + 0.001D * (event_id % 3) END AS value")
    return charts.log_scale(points, ["k"], ["event_id"])


@query("""
    WITH c(k, pts) AS (VALUES (0, [[20.0, 0.0], [120.0, 5.0], [420.0, 30.0]]), (1, [[0.0, 1.0], [100.0, 10.0], [200.0, 100.0], [300.0, 1000.0]]), (2, [[50.0, 7.5]]), (3, CAST([] AS DOUBLE[][]))),
    p AS (SELECT p_partkey, CAST(p_size * 10 + p_partkey % 10 - 30 AS DOUBLE) AS px, p_partkey % 4 AS k FROM part),
    s AS (SELECT p.*, pts, len(pts) AS n, CASE WHEN px <= pts[1][1] THEN 2 WHEN px >= pts[-1][1] THEN len(pts) ELSE len(list_filter(pts, lambda q: q[1] < px)) + 1 END AS i FROM p JOIN c USING (k))
    SELECT p_partkey, CAST(floor(1000 * CASE WHEN n = 0 THEN px / 500 * 30 WHEN n = 1 THEN pts[1][2] ELSE pts[i - 1][2] + (px - pts[i - 1][1]) * (pts[i][2] - pts[i - 1][2]) / (pts[i][1] - pts[i - 1][1]) END + 0.5) AS BIGINT) AS data_milli FROM s""")
def pixel_to_data(spark, sf_dir):
    made = spark.createDataFrame([(0, [(20.0, 0.0), (120.0, 5.0), (420.0, 30.0)]), (1, [(0.0, 1.0), (100.0, 10.0), (200.0, 100.0), (300.0, 1000.0)]), (2, [(50.0, 7.5)]), (3, [])], "k int, points array<struct<pixel:double,value:double>>")
    pixels = table(spark, sf_dir, "part").selectExpr("p_partkey", "CAST(p_size * 10 + p_partkey % 10 - 30 AS DOUBLE) AS px", "CAST(p_partkey % 4 AS INT) AS k").join(F.broadcast(made), "k")
    value = charts.pixel_to_data(F.col("px"), F.col("points"), F.size("points") > 0, F.lit(500.0), F.lit(0.0), F.lit(30.0))
    return pixels.select("p_partkey", F.floor(value * 1000 + 0.5).alias("data_milli"))


_LABEL = "CASE l_linenumber % 4 WHEN 0 THEN replace(CAST(l_quantity::BIGINT AS VARCHAR), '0', 'O') WHEN 1 THEN replace(CAST(l_quantity::BIGINT AS VARCHAR), '1', 'l') || ' m' WHEN 2 THEN '-' || (l_partkey % 100) || '·' || (l_suppkey % 10) ELSE 'Tick ' || (l_orderkey % 1000) || ',5' END"


@query(f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, {_LABEL} AS label FROM lineitem UNION ALL SELECT * FROM (VALUES (-1, 1, ''), (-2, 1, 'abc'), (-3, 1, ' +3.5e2 '), (-4, 1, '.'), (-5, 1, '.5'), (-6, 1, '7.')) AS f(a, b, c)),
    c AS (SELECT *, replace(replace(replace(replace(replace(replace(trim(label), 'O', '0'), 'o', '0'), 'l', '1'), '·', '.'), ',', '.'), ' ', '') AS s FROM t)
    SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, label, CAST(round(1000 * CASE WHEN regexp_matches(s, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(s AS DOUBLE) ELSE try_cast(nullif(regexp_extract(s, '-?[0-9]+[.]?[0-9]*'), '') AS DOUBLE) END) AS BIGINT) AS value_milli FROM c""")
def parse_ticks(spark, sf_dir):
    label = F.expr("CASE l_linenumber % 4 WHEN 0 THEN replace(CAST(CAST(l_quantity AS BIGINT) AS STRING), '0', 'O') WHEN 1 THEN replace(CAST(CAST(l_quantity AS BIGINT) AS STRING), '1', 'l') || ' m' WHEN 2 THEN '-' || (l_partkey % 100) || '·' || (l_suppkey % 10) ELSE 'Tick ' || (l_orderkey % 1000) || ',5' END")
    extra = spark.createDataFrame([(-1, 1, ""), (-2, 1, "abc"), (-3, 1, " +3.5e2 "), (-4, 1, "."), (-5, 1, ".5"), (-6, 1, "7.")], "l_orderkey bigint, l_linenumber int, label string")
    ticks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), label.alias("label")).unionByName(extra)
    return ticks.select("l_orderkey", "l_linenumber", "label", F.round(C.parse_tick(F.col("label")) * 1000).cast("bigint").alias("value_milli"))


@query("""
    WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey % 5000 AS DOUBLE) WHEN 1 THEN CAST(l_quantity * 100 AS DOUBLE) ELSE -1.0 * l_suppkey END AS v FROM lineitem)
    SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, coalesce(v > 0 AND abs(v / pow(10.0, floor(log10(CASE WHEN v > 0 THEN v END))) - round_even(v / pow(10.0, floor(log10(CASE WHEN v > 0 THEN v END))), 0)) < 0.000001, false) AS nice FROM v""")
def nice_ticks(spark, sf_dir):
    value = F.expr("CASE l_linenumber % 3 WHEN 0 THEN CAST(l_partkey % 5000 AS DOUBLE) WHEN 1 THEN CAST(l_quantity * 100 AS DOUBLE) ELSE -1.0D * l_suppkey END")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), C.is_nice_log_tick(value).alias("nice"))


_CENTRES = "(0, 0, 40.0, 3), (0, 1, 90.0, 1), (0, 2, 200.0, 2), (1, 0, 100.0, 5), (2, 0, 10.0, 1), (2, 1, 60.0, 2), (2, 2, 110.0, 3), (2, 3, 160.0, 4)"


@query(f"""
    WITH c(k, seq, x, class) AS (VALUES {_CENTRES}), g AS (SELECT k, x - lag(x) OVER (PARTITION BY k ORDER BY x) AS gap FROM c), s AS (SELECT k, median(gap) FILTER (gap > 0) AS step FROM g GROUP BY 1),
    n AS (SELECT event_id, p.k, class, abs(x - value) AS d, step, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - value), seq) AS r FROM (SELECT event_id, event_id % 3 AS k, value FROM events) p JOIN c USING (k) JOIN s USING (k))
    SELECT event_id, CAST(max(class) FILTER (r = 1) AS INTEGER) AS class, CAST(max(CASE WHEN r = 2 AND d <= step * 0.75 THEN class END) AS INTEGER) AS second FROM n GROUP BY 1""")
def nearest_class(spark, sf_dir):
    centres = spark.sql(f"SELECT CAST(k AS BIGINT) k, seq, CAST(x AS DOUBLE) x, class FROM VALUES {_CENTRES} AS v(k, seq, x, class)")
    points = table(spark, sf_dir, "events").selectExpr("event_id AS point_id", "event_id % 3 AS k", "value AS px")
    found = charts.nearest_class(points, F.broadcast(centres), ["k"])
    return found.select(F.col("point_id").alias("event_id"), "class", F.get("class_candidates", 1).alias("second"))


_PANEL = "('a', 180.0, 200.0, 420.0, 420.0), ('b', 330.0, 90.0, 560.0, 300.0)"


@query(f"""
    WITH {LINES}, p(panel_id, px0, py0, px1, py1) AS (VALUES {_PANEL}),
    m AS (SELECT *, px1 - px0 AS w, py1 - py0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM lines, p),
    f AS (SELECT *, y0 > py1 AND y1 < py1 + h * 0.3 AS under FROM m)
    SELECT doc_id, page_no, panel_id, arg_min(text, y0 * 1000000 + block_seq) FILTER (under AND cx > px0 - w * 0.2 AND cx < px1 + w * 0.2) AS x_label,
           arg_min(text, -x1 * 1000000 + block_seq) FILTER (x1 < px0 AND cy > py0 - h * 0.2 AND cy < py1 + h * 0.2) AS y_label,
           arg_min(text, cy * 1000000 + block_seq) FILTER (cx > px0 - w * 0.1 AND cx < px1 + w * 0.1 AND ((y1 < py0 AND y0 > py0 - h * 0.3) OR under)) AS caption FROM f GROUP BY 1, 2, 3""")
def axis_labels(spark, sf_dir):
    own = lines(spark, sf_dir)
    panels = spark.sql(f"SELECT panel_id, CAST(px0 AS DOUBLE) px0, CAST(py0 AS DOUBLE) py0, CAST(px1 AS DOUBLE) px1, CAST(py1 AS DOUBLE) py1 FROM VALUES {_PANEL} AS v(panel_id, px0, py0, px1, py1)")
    return charts.panel_labels(own, own.select("doc_id", "page_no").distinct().join(F.broadcast(panels)))


@query(f"""
    WITH {LINES}, p(panel_id, px0, py0, px1, py1) AS (VALUES {_PANEL}),
    m AS (SELECT *, {squeeze_sql('text')} AS s, px1 - px0 AS w, py1 - py0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM lines, p),
    g AS (SELECT *, regexp_matches(s, '^[0-9]+[.)]') OR regexp_matches(s, '^.{{0,12}}?(fic|fig|figure)[.]?\\s*[0-9]', 'i') AS legend FROM m)
    SELECT doc_id, page_no, panel_id, coalesce(arg_min(s, (y0 - py1) * 1000000000 - length(s) * 1000 + block_seq % 1000) FILTER (NOT legend AND length(s) >= 4 AND y0 > py1 AND y0 <= py1 + greatest(h * 0.25, 40) AND cx BETWEEN px0 + w * 0.15 AND px1 - w * 0.15), '') AS x_label,
           coalesce(arg_min(s, -length(s) * 1000000000 + x1 * 1000 + block_seq % 1000) FILTER (NOT legend AND length(s) >= 3 AND x1 < px0 + w * 0.05 AND cy BETWEEN py0 - h * 0.05 AND py1 + h * 0.05), '') AS y_label FROM g GROUP BY 1, 2, 3""")
def structure_labels(spark, sf_dir):
    own = lines(spark, sf_dir)
    panels = spark.sql(f"SELECT panel_id, CAST(px0 AS DOUBLE) px0, CAST(py0 AS DOUBLE) py0, CAST(px1 AS DOUBLE) px1, CAST(py1 AS DOUBLE) py1 FROM VALUES {_PANEL} AS v(panel_id, px0, py0, px1, py1)")
    return charts.structure_labels(own, own.select("doc_id", "page_no").distinct().join(F.broadcast(panels))).select("doc_id", "page_no", "panel_id", "x_label", "y_label")


_HUES = "CASE WHEN s < 20 THEN CASE WHEN v < 80 THEN 'black' END WHEN h BETWEEN 0 AND 12.5 OR h > 168.5 AND h <= 190 OR h < 0 AND h >= -10 THEN 'red' WHEN h > 12.5 AND h <= 24.5 THEN 'orange' WHEN h > 24.5 AND h <= 37.5 THEN 'yellow' WHEN h > 37.5 AND h <= 79.5 THEN 'green' WHEN h > 79.5 AND h <= 99.5 THEN 'cyan' WHEN h > 99.5 AND h <= 139.5 THEN 'blue' WHEN h > 139.5 AND h <= 159.5 THEN 'purple' WHEN h > 159.5 AND h <= 168.5 THEN 'magenta' END"


@query(f"SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, {_HUES} AS color FROM (SELECT l_orderkey, l_linenumber, l_partkey % 800 / 4.0 AS h, l_suppkey % 60 AS s, l_orderkey % 256 AS v FROM lineitem)")
def color_name(spark, sf_dir):
    hsv = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS INT) l_linenumber", "l_partkey % 800 / 4.0D AS h", "l_suppkey % 60 AS s", "l_orderkey % 256 AS v")
    return hsv.select("l_orderkey", "l_linenumber", C.color_name(F.col("h"), F.col("s"), F.col("v")).alias("color"))


@query()
def tick_pairing(spark, sf_dir):
    """Greedy, by order of ticks; held against a Python version in the tests."""
    events = table(spark, sf_dir, "events")
    keys = ["user_id", "event_type"]
    ticks = events.where("event_id % 2 = 0").select(*keys, F.col("value").alias("pixel"))
    labels = events.where("event_id % 2 = 1").select(*keys, F.col("event_id").alias("seq"), F.col("value").alias("place"), (F.col("event_id") % 100).cast("double").alias("value"))
    return charts.pair_ticks(ticks, labels, keys)


@query("""
    WITH a AS (SELECT k, CAST(z AS INTEGER) AS z, 60.0 * z + 13 * k AS x, 45.0 * (z * 7 % 9) AS y FROM range(3) AS t(k), range(1, 10) AS u(z)),
    p AS (SELECT event_id AS point_id, event_id % 3 AS k, value AS px, CAST(event_id % 400 AS DOUBLE) AS py FROM events),
    o AS (SELECT k, point_id, z, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((px - x) ** 2 + (py - y) ** 2), z) AS r FROM p JOIN a USING (k))
    SELECT k, point_id, string_agg(z, ',' ORDER BY r) FILTER (r <= 3) AS class_candidates, min(z) FILTER (r = 1) AS class FROM o GROUP BY 1, 2""")
def zone_candidates(spark, sf_dir):
    anchors = spark.createDataFrame([(k, z, 60.0 * z + 13 * k, 45.0 * (z * 7 % 9)) for k in range(3) for z in range(1, 10)], "k bigint, zone int, x double, y double")
    points = table(spark, sf_dir, "events").selectExpr("event_id AS point_id", "event_id % 3 AS k", "value AS px", "CAST(event_id % 400 AS DOUBLE) AS py")
    found = charts.anchor_candidates(points, F.broadcast(anchors), ["k"])
    return found.withColumn("class_candidates", F.array_join(F.col("class_candidates").cast("array<string>"), ","))
