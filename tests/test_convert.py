"""Conversion of images, PDFs and texts, chart orchestration, and the benchmark driver, on files made here."""

import json
import os
import stat

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.functions import raster
from leafmill.plans import benchmark, convert
from leafmill.sources import binary
from tests.test_raster import canvas, line


def framed(color=None, diagonals=()):
    """Two framed panels; upright strokes and a dot of a colour in the left one, diagonals in the right."""
    image = canvas(600, 300)
    for x0 in (20, 320):
        for a in ((x0, 40, x0 + 250, 40), (x0, 260, x0 + 250, 260), (x0, 40, x0, 260), (x0 + 250, 40, x0 + 250, 260)):
            line(image, *a)
    if color:
        for x in (80, 130, 180):
            line(image, x, 70, x, 200, color, 4)
        image[100:106, 150:156] = color
    for d in diagonals:
        line(image, *d)
    return image


def ppm(path, image):
    path.write_bytes(b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + image.tobytes())


def test_charts_by_colour_then_structure_and_zones():
    items = raster.chart_items(framed((220, 20, 20)), ["red"])
    assert sorted((i["item_type"], i["panel_id"], i["class"]) for i in items if i["source"] == "color") == [("interval", "a", 0), ("interval", "a", 1), ("interval", "a", 2), ("point", "a", 1)]
    point = next(i for i in items if i["item_type"] == "point")
    assert point["class_candidates"] == [1, 2] and point["depth"] == pytest.approx(7.8, abs=0.5)
    plain = raster.chart_items(framed(), ["red"])
    assert {i["item_type"] for i in plain} == {"chart_detected"} and len(plain) == 2
    zones = raster.chart_items(framed(diagonals=[(340, 240, 550, 70)]), ["red"])
    assert {(i["source"], i["panel_id"]) for i in zones} >= {("structure", "chart"), ("zones", "b")}
    assert raster.chart_items(canvas()) == []


def test_chart_pages(spark, tmp_path):
    ppm(tmp_path / "red.ppm", framed((220, 20, 20)))
    ppm(tmp_path / "plain.ppm", framed())
    (tmp_path / "bad.ppm").write_bytes(b"P6 nothing")
    files = binary.discover(spark, str(tmp_path))
    rows = binary.chart_pages(files, ["red"], deskew=False).collect()
    by = {(r.path.rsplit("/", 1)[1], r.item_type) for r in rows}
    assert by == {("red.ppm", "interval"), ("red.ppm", "point"), ("plain.ppm", "chart_detected")}
    red = sorted((r for r in rows if r.path.endswith("red.ppm")), key=lambda r: r.seq)
    assert [r.seq for r in red] == list(range(4)) and all(r.color == "red" and r.depth_tolerance > 0 for r in red)


def fake_ocr(tmp_path):
    """A binary that reads any page as a heading over a line in two columns."""
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"]
    rows += [f"5\t1\t1\t1\t{n}\t{i}\t{x}\t{y}\t{w}\t12\t90\t{t}" for n, i, x, y, w, t in ((1, 1, 30, 10, 80, "1."), (1, 2, 115, 10, 60, "Results"), (2, 1, 30, 60, 40, "friction"), (2, 2, 75, 60, 40, "sleeve"), (2, 3, 400, 60, 60, "apart"))]
    at = tmp_path / "ocr.sh"
    at.write_text("#!/bin/sh\ncat > /dev/null\nprintf '" + "\\n".join(r.replace("\t", "\\t") for r in rows) + "\\n'\n")
    os.chmod(at, os.stat(at).st_mode | stat.S_IXUSR)
    return str(at)


def test_convert_images_and_texts(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    ppm(source / "scan.ppm", framed((220, 20, 20)))
    (source / "bad.png").write_bytes(b"no image")
    (source / "book.pdf").write_bytes(b"no pdf")
    (source / "t.txt").write_text("Head\n\nA body that ends here.")
    (source / "odd.xyz").write_text("?")
    options = convert.Options(str(source), out, "all", deskew=False, chart_colors="red", ocr_command=fake_ocr(tmp_path))
    status = {r.path.rsplit("/", 1)[1]: (r.rc, len(r.warnings) > 0) for r in convert.convert(spark, options).collect()}
    assert status == {"scan.ppm": (0, False), "bad.png": (1, True), "book.pdf": (1, True), "t.txt": (0, False), "odd.xyz": (1, True)}
    md = {r.stem: r.markdown for r in spark.read.parquet(f"{out}/md").collect()}
    assert "friction sleeve" in md["scan"] and "### Panel a" in md["scan"] and "A body that ends here." in md["t"] and "was not read" in md["bad"]
    assert set(md) == {"scan", "bad", "book", "t"} and {r.stem for r in spark.read.parquet(f"{out}/rag").collect()} == set(md)
    again = convert.Options(str(source), out, "md", resume=True)
    assert {r.path.rsplit("/", 1)[1] for r in convert.inputs(spark, again).collect()} == {"odd.xyz"}


def test_convert_without_ocr_tells_so(spark, tmp_path):
    if binary.ocr_binary() is not None:
        pytest.skip("an OCR binary is here")
    (tmp_path / "in").mkdir()
    ppm(tmp_path / "in" / "a.ppm", canvas(200, 100))
    (row,) = convert.convert(spark, convert.Options(str(tmp_path / "in"), str(tmp_path / "out"))).collect()
    assert row.rc == 0 and row.warnings == ["FileNotFoundError: no OCR binary"]
    assert "not read: FileNotFoundError" in spark.read.parquet(str(tmp_path / "out" / "md")).first().markdown


def test_pages_of_pdfs_are_drawn(spark, tmp_path):
    """A stand-in for the drawing library: a document of as many pages as its bytes say."""
    at = tmp_path / "pypdfium2.py"
    at.write_text(
        "import numpy as np\nclass PdfDocument:\n    def __init__(self, content):\n        self.n = int(content)\n    def __len__(self):\n        return self.n\n    def __getitem__(self, i):\n        return self\n"
        "    def render(self, scale):\n        return self\n    def to_numpy(self):\n        return np.full((20, 30, 3), 255, np.uint8)\n"
    )
    spark.sparkContext.addPyFile(str(at))
    (tmp_path / "b.pdf").write_bytes(b"11")
    (tmp_path / "c.pdf").write_bytes(b"x")
    rows = binary.rendered(binary.discover(spark, str(tmp_path))).collect()
    assert sorted(r.page_no for r in rows if r.error is None) == list(range(11)) and {(r.width, r.height) for r in rows if r.error is None} == {(30, 20)}
    assert [r.path[-5:] for r in rows if r.error] == ["c.pdf"]


def document(*blocks, warnings=()):
    return {"source": "s", "warnings": list(warnings), "pages": [{"number": 1, "width": 10.0, "height": 20.0, "warnings": [], "blocks": [{"type": t, "text": x, **more} for t, x, more in blocks]}]}


def test_benchmark(spark, tmp_path):
    data, out = tmp_path / "data", tmp_path / "out"
    (data / "expected").mkdir(parents=True)
    out.mkdir()
    ids = ["same", "worse", "chart", "other", "lost", "broken"]
    manifest = {"name": "m", "version": "1", "documents": [{"id": i, "path": f"{i}.pdf", "language": "en", "type": "paper" if i != "chart" else "chart", "features": ["f"], "difficulty": "easy"} for i in ids]}
    (data / "manifest.json").write_text(json.dumps(manifest))
    plain = document(("title", "A title", {}), ("table", "| a | b |", {"metadata": {"rows": 1, "cols": 2}}))
    point = {"metadata": {"chart_data": [{"type": "interval", "panel_id": "a", "class": 1, "start_depth": 2.0, "end_depth": 5.0}]}}
    golden = {"sample_id": "g", "required_terms": ["depth"], "panels": [{"id": "a", "caption": "CPT", "predicted_intervals": [{"class": 1, "start_depth": 2.0, "end_depth": 5.0}], "predicted_points": []}]}
    goldens = {"same": plain, "worse": plain, "chart": golden, "other": {"b": 1, "a": 2}, "lost": plain, "broken": plain}
    actual = {"same": plain, "worse": document(("paragraph", "A title", {}), warnings=["w1", "w2", "w3", "w4"]), "chart_v2": document(("figure", "CPT depth", point)), "other": {"a": 2, "b": 1}}
    for name, value in goldens.items():
        (data / "expected" / f"{name}.expected.json").write_text(json.dumps(value))
    for name, value in actual.items():
        (out / f"{name}.json").write_text(json.dumps(value))
    (out / "broken.json").write_text("{no")
    run = benchmark.benchmark(spark, str(data / "manifest.json"), str(out))
    scores = {r.doc_id: (r.overall, r.error, r.status) for r in run.scores.collect()}
    assert scores["same"] == (1.0, None, "OK") and scores["chart"] == (1.0, None, "OK") and scores["other"] == (1.0, None, "OK")
    assert scores["lost"][1:] == ("no output", "ERR") and scores["broken"][1:] == ("not JSON", "ERR")
    metrics = {(r.doc_id, r.name): (r.score, r.detail) for r in run.metrics.collect()}
    assert metrics["worse", "block_count"][0] == 0.5 and metrics["worse", "table_detection"][0] == 0.0 and metrics["worse", "content_completeness"] == (0.0, "warnings: w1; w2; w3")
    assert metrics["same", "text_similarity"] == (1.0, "no warnings") and len([k for k in metrics if k[0] == "chart"]) == 5
    s = run.summary.first()
    assert (s.total, s.completed, s.failed) == (6, 4, 2)
    assert {(r.family, r.category, r.n) for r in run.gaps.collect()} >= {("type", "chart", 1), ("feature", "f", 4), ("lang", "en", 4)}
    text = run.report()
    assert "| lost |" in text and "no output" in text and text.startswith("# ")


def test_routes(spark):
    rows = [('{"panels": []}',), ('{"required_terms": [], "pages": []}',), ('{"pages": []}',), ('{"x": 1}',), ("{",)]
    assert [r[0] for r in spark.createDataFrame(rows, "j string").select(benchmark.route(F.col("j"))).collect()] == ["chart", "chart", "document", "text", None]


def test_arguments():
    options = convert.Options(**vars(convert.parser().parse_args(["a", "b", "--format", "llm-v1", "--no-deskew", "--rag-ready", "--chart-colors", "red,blue", "--batch-size", "3", "--output-suffix", "_v2", "-r", "-w", "4"])))
    assert options.source == ["a", "b"] and not options.deskew and options.formats == ("llm-v1", "rag") and options.colors == ["red", "blue"] and options.batch == 3 and options.suffix == "_v2" and options.recursive and options.workers == 4
