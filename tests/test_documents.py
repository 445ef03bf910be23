"""Behaviour of sources, renderers, evaluation and charts on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from leafmill.functions import chart as C
from leafmill.operators import charts, evals, order, render, runtime
from leafmill.sources.text import text_to_blocks

B = "doc_id bigint, page_no int, block_seq int, type string, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def blocks(spark, rows):
    return order.default_order(spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], B))


def test_text_blocks(spark):
    docs = spark.createDataFrame([(1, "Main Title\n\nFirst line\nsecond line"), (2, "Name  Amount\nAlice  42\nBob  7"), (3, None)], "doc_id bigint, text string")
    got = text_to_blocks(docs).orderBy("doc_id", "block_seq").collect()
    assert [(r.doc_id, r.type, r.text) for r in got] == [(1, "heading", "Main Title"), (1, "paragraph", "First line second line"), (2, "table", "| Name | Amount |\n| --- | --- |\n| Alice | 42 |\n| Bob | 7 |")]


def test_markdown(spark):
    rows = [("heading", "Invoice", 0.0, 0.0, 9.0, 9.0, None), ("figure", "", 1.0, 22.0, 3.0, 24.0, None), ("uncertain", "T0ta1", 0.0, 48.0, 1.0, 49.0, None), ("formula", "qt = qc", 0.0, 60.0, 1.0, 61.0, None), ("formula", "x_{1}", 0.0, 72.0, 1.0, 73.0, None)]
    text = render.markdown(blocks(spark, rows)).first().markdown
    assert text == "# Page 1\n\n## Invoice\n\n[Figure: page=1, bbox=1.0,22.0,3.0,24.0, caption=not detected]\n\n[uncertain: T0ta1]\n\n$$q_t = q_c$$\n\n$$x_{1}$$\n"
    plain = render.plain_text(blocks(spark, rows[:1])).first().text
    assert plain == "Page 1\n\n======\n\nInvoice\n"


CHART = [("interval", "a", 1, None, 2.0, 5.0, None, None), ("point", "a", 2, [2, 3], None, None, 3.5, 0.4), ("interval", "a", 10, None, 1.0, 2.0, None, None), ("interval", "a", 9, None, 3.0, 4.0, None, 0.3)]


def test_charts_in_texts(spark):
    frame = blocks(spark, [("figure", "note", 0.0, 0.0, 9.0, 9.0, 50.0)]).withColumn("chart", F.from_json(F.lit(json.dumps([dict(zip(("item_type", "panel_id", "class", "class_candidates", "start_depth", "end_depth", "depth", "depth_tolerance"), c)) for c in CHART])), render.CHART))  # noqa: B905
    v2 = render.compact(frame).first().text
    assert "[CHART a] 1: 2.0-5.0; 10: 1.0-2.0; 9: 3.0-4.0 ±0.3; pts(2/3:3.5 ±0.4)\nfig_note→ note" in v2
    v1 = render.legacy(frame).first().text
    assert "    intervals: class 1 depth 2.0-5.0; class 9 depth 3.0-4.0 +/- 0.3; class 10 depth 1.0-2.0\n    points: class 2/3 depth 3.5 +/- 0.4\nfigure_note: note" in v1
    assert "| 1 | 2.0 | 5.0 |\n| 9 | 3.0 +/- 0.3 | 4.0 +/- 0.3 |" in render.markdown(frame).first().markdown
    assert "[CHART a]" in render.lean(frame).first().text and "chart_data:" in render.plain_text(frame).first().text


def test_json_keeps_nulls(spark):
    got = json.loads(render.json_documents(blocks(spark, [("paragraph", "x", None, None, None, None, 99.5)])).first().json)
    assert got["pages"][0]["blocks"][0] == {"type": "paragraph", "text": "x", "confidence": 99.5, "bbox": None} and got["pages"][0]["width"] is None


@pytest.mark.parametrize("placeholder,low,high", [(True, 0.0, 0.2), (False, 0.85, 1.0)])
def test_chart_evaluation(spark, placeholder, low, high):
    make = spark.createDataFrame
    text = "placeholder figure" if placeholder else "class 1 soil depth figure a"
    items = [] if placeholder else [(1, 0, "interval", "a", 1, None, 2.0, 5.05, None, None, None, None)]
    actual = make(items, "doc_id bigint, seq int, item_type string, panel_id string, class int, class_candidates array<int>, start_depth double, end_depth double, depth double, depth_tolerance double, x_label string, y_label string")
    m = evals.chart_eval(
        make([(1, not placeholder, 1, int(placeholder))], "doc_id bigint, has_size boolean, n_blocks int, n_warnings int"), make([(1, text)], "doc_id bigint, text string"),
        make([(1, "Soil"), (1, "DEPTH")], "doc_id bigint, term string"), make([(1, "figure a")], "doc_id bigint, label string"),
        make([(1, 0, "a", "1", 2.0, 5.0)], "doc_id bigint, exp_id int, panel_id string, class string, start_depth double, end_depth double"),
        make([], "doc_id bigint, exp_id int, panel_id string, class string, depth double"), make([], "doc_id bigint, panel_id string, x_label string, y_label string"), actual,
    )
    assert low <= evals.weighted(m).first().overall <= high


def test_detected_charts_blend(spark):
    actual = spark.createDataFrame([(1, "chart_detected", "chart", "Friction ratio", "Cone resistance")], "doc_id bigint, item_type string, panel_id string, x_label string, y_label string")
    want = spark.createDataFrame([(1, "a", "friction-ratio", ""), (1, "b", "time", ""), (1, "c", "", "")], "doc_id bigint, panel_id string, x_label string, y_label string")
    assert {r.panel_id: r.found for r in evals.charts_found(want, actual).collect()} == {"a": True, "b": False, "c": False}
    row = spark.range(1).select(evals.chart_score(F.lit(8), F.lit(10), F.lit(1), F.lit(2), F.lit(True)).alias("a"), evals.chart_score(F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(False)).alias("b")).first()
    assert row.a == pytest.approx(0.68) and row.b == 1.0


def test_ticks(spark):
    values = {1.0: True, 2.0: True, 3.0: True, 50.0: True, 100.0: True, 16.0: False, 7.5: False, 0.0: False, -5.0: False}
    got = {r.v: r.n for r in spark.createDataFrame([(v,) for v in values], "v double").select("v", C.is_nice_log_tick(F.col("v")).alias("n")).collect()}
    assert got == values
    row = spark.range(1).select(C.tick_to_data(F.lit("log"), F.lit(0.01), F.lit(0.0), F.lit(100.0)).alias("a"), C.tick_to_data(F.lit("linear"), F.lit(0.04), F.lit(-4.0), F.lit(200.0)).alias("b")).first()
    assert row.a == pytest.approx(10) and row.b == pytest.approx(4)


def test_log_scale_and_intervals(spark):
    series = {1: [30.0, 28.0, 26.0], 2: [10.0, 20.0, 30.0], 3: [1.0, 10.0, 100.0], 4: [1.0, 10.0], 5: [0.0, 1.0, 10.0]}
    frame = spark.createDataFrame([(k, i, v) for k, vs in series.items() for i, v in enumerate(vs)], "k int, i int, value double")
    assert {r.k: r.log_scale for r in charts.log_scale(frame, ["k"], ["i"]).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    bars = spark.createDataFrame([("a", 1, "r", s, e, 0.1) for s, e in ((0.0, 1.0), (1.4, 2.0), (2.6, 3.0))], "panel_id string, class int, color string, start_depth double, end_depth double, depth_tolerance double")
    assert sorted((r.start_depth, r.end_depth) for r in charts.merge_intervals(bars).collect()) == [(0.0, 2.0), (2.6, 3.0)]
    dots = spark.createDataFrame([("a", 1, "r", i, d) for i, d in enumerate((1.5, 2.5, 0.5))], "panel_id string, class int, color string, seq int, depth double")
    assert sorted(r.depth for r in charts.dedup_points(dots).collect()) == [0.5, 1.5]


def test_tick_lines(spark):
    ticks = [(1, v, 100.0 * i, 90.0) for i, v in enumerate((1.0, 10.0, 100.0))] + [(1, 16.0, 150.0, 90.0), (1, 10.0, 105.0, 90.0), (1, 3.0, 400.0, 10.0)]
    fit = charts.tick_lines(spark.createDataFrame(ticks, "k int, value double, px double, conf double"), ["k"], True).first()
    assert fit.kind == "log" and fit.a == pytest.approx(0.01, abs=5e-4) and fit.b == 0.0


def test_constant_axis_has_no_fit(spark):
    fit = charts.regression(spark.createDataFrame([(1, 1.0, 5.0), (1, 2.0, 5.0), (2, 1.0, 2.0), (2, 2.0, 4.0)], "k int, pixel double, value double"), ["k"])
    assert {r.k: (r.r_squared, r.calibrated) for r in fit.collect()} == {1: (0.0, False), 2: (1.0, True)}


def test_interpolation(spark):
    points = F.array(*[F.struct(F.lit(float(p)).alias("pixel"), F.lit(float(v)).alias("value")) for p, v in ((0, 1), (100, 10), (200, 100))])
    frame = spark.createDataFrame([(float(p),) for p in (-100, 0, 50, 100, 150, 300)], "px double")
    arg = (points, F.lit(True), F.lit(300.0), F.lit(0.0), F.lit(30.0))
    got = frame.select(charts.pixel_to_data(F.col("px"), *arg).alias("a"), charts.pixel_to_data_log(F.col("px"), *arg).alias("b")).collect()
    assert [r.a for r in got] == [-8.0, 1.0, 5.5, 10.0, 55.0, 190.0]
    assert [r.b for r in got] == pytest.approx([0.1, 1.0, 10**0.5, 10.0, 10**1.5, 1000.0])


def test_attach(spark):
    base = spark.createDataFrame([(1, 0, 0, "paragraph", "p"), (1, 0, 1, "figure", "f"), (1, 1, 0, "paragraph", "q")], "doc_id bigint, page_no int, block_seq int, type string, text string")
    items = spark.createDataFrame([(1, p, 0, "point", "a", 1, None, None, None, 2.0, None) for p in (0, 1)], "doc_id bigint, page_no int, seq int, item_type string, panel_id string, class int, class_candidates array<int>, start_depth double, end_depth double, depth double, depth_tolerance double")
    got = charts.attach_to_figures(base, items).orderBy("page_no", "block_seq").collect()
    assert [(r.page_no, r.block_seq, r.type, r.chart is not None) for r in got] == [(0, 0, "paragraph", False), (0, 1, "figure", True), (1, 0, "paragraph", False), (1, 1, "figure", True)]


def test_runtime(spark):
    files = spark.createDataFrame([(0, "a/x.pdf"), (1, "a/y.PNG"), (2, "a/z.xyz"), (3, "a/x.pdf"), (4, "b/.hidden")], "seq int, path string")
    assert {(r.path, r.kind) for r in runtime.supported(files).collect()} == {("a/x.pdf", "pdf"), ("a/y.PNG", "image")}
    done = spark.createDataFrame([("x_v1",)], "stem string")
    assert {r.path for r in runtime.pending(runtime.supported(files), done, "_v1").collect()} == {"a/y.PNG"}
    times = spark.createDataFrame([(0.0,), (65.4,), (3725.0,), (None,)], "s double").select(runtime.duration(F.col("s")).alias("d")).collect()
    assert [r.d for r in times] == ["--:--", "01:05", "1:02:05", "--:--"]
    out = spark.range(1).select(runtime.output_path(F.lit("out"), F.lit("in/a.b.pdf"), "_v", per_file=True).alias("p")).first()
    assert out.p == "out/a.b/a.b_v.json"


def test_pairs_of_files(spark):
    actual = spark.createDataFrame([("a", "1"), ("ab", "2"), ("b_x", "3"), ("b_w", "4")], "stem string, path string")
    golden = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, stem string")
    assert {r.doc_id: r.path for r in evals.pair_files(actual, golden).collect()} == {1: "1", 2: "4", 3: None}
