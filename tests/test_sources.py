"""Sources, streams and the command line on files made here."""

import json

import numpy as np
from pyspark.sql import functions as F

from leafmill.operators import tables
from leafmill.plans import convert
from leafmill.sources import binary, jsondoc
from leafmill.sources.text import text_to_blocks
from leafmill.sources.words import read_words
from leafmill.streaming.files import SCHEMA, blocks_from, paragraphs_by_arrival


def test_stream_equals_batch(spark, tmp_path):
    docs = [{"doc_id": i, "text": f"Title {i}\n\nbody of {i}.\nmore."} for i in range(12)]
    for i in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(d) for d in docs[i * 3 : i * 3 + 3]))
    for _ in range(2):  # the second run finds nothing new
        assert blocks_from(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), 1).awaitTermination(120)
    want = text_to_blocks(spark.read.schema(SCHEMA).json(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))


def test_windows_with_late_rows(spark, tmp_path):
    for i, minute in enumerate((0, 4, 1, 30, 2)):
        (tmp_path / f"{i}.json").write_text(json.dumps({"doc_id": i, "text": "a\n\nb", "ts": f"2024-01-01T00:{minute:02d}:00Z"}))
    query = paragraphs_by_arrival(spark, str(tmp_path), files_a_batch=1).writeStream.outputMode("append").format("memory").queryName("arrived").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.table("arrived").collect()
    assert rows and all(r.paragraphs == 2 * r.documents for r in rows)


def test_images_tables_and_missing_ocr(spark, tmp_path):
    image = np.full((200, 300), 255, np.uint8)
    image[20:22, 20:281] = image[100:102, 20:281] = image[180:182, 20:281] = 0
    image[20:182, 20:22] = image[20:182, 150:152] = image[20:182, 280:282] = 0
    (tmp_path / "a.pgm").write_bytes(b"P5\n# drawn\n300 200\n255\n" + image.tobytes())
    (tmp_path / "b.png").write_bytes(b"no image")
    (tmp_path / "c.txt").write_text("no")
    files = binary.discover(spark, str(tmp_path))
    pages = binary.images(files, deskew=False)
    status = {r.path.split("/")[-1]: r.error for r in pages.select("path", "error").collect()}
    assert set(status) == {"a.pgm", "b.png"} and status["a.pgm"] is None and status["b.png"]
    cells = binary.table_grids(pages)
    assert cells.count() == 4
    words = cells.where("r = 0 AND c = 0").select("path", "page_no", F.lit(0).alias("block_seq"), F.lit("hello").alias("text"), (F.col("x0") + 5).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x0") + 50).alias("x1"), (F.col("y0") + 20).alias("y1")).withColumn("doc_id", F.lit(1))
    found = tables.grid_cells(words, cells.withColumn("doc_id", F.lit(1)).select("doc_id", "page_no", "r", "c", "x0", "y0", "x1", "y1"))
    assert {(r.r, r.c): r.text for r in found.collect()}[0, 0] == "hello" and found.count() == 4
    if binary.ocr_binary() is None:
        assert [r.error for r in binary.ocr(pages).collect()] == ["FileNotFoundError: no OCR binary"]
    assert binary.chart_structures(pages).count() == 1


def test_rotation():
    image = np.zeros((4, 6), np.uint8)
    image[0, 0] = 9
    assert binary.rotate(image, 90).shape == (6, 4) and binary.rotate(binary.rotate(image, 180), 180)[0, 0] == 9
    assert binary.prepare(np.full((8, 8, 3), 120, np.uint8)).shape == (8, 8)


def test_words_and_lines(spark, tmp_path):
    rows = ["level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"]
    rows += [f"5\t1\t1\t1\t1\t{i}\t{x}\t10\t30\t12\t{c}\t{t}" for i, (x, c, t) in enumerate([(10, 90, 'say "hi'), (45, 80, "there"), (300, 95, "apart"), (350, 10, "unsure"), (400, 90, " ")])]
    (tmp_path / "w.tsv").write_text("\n".join(rows))
    from leafmill.operators.lines import ocr_lines

    words = read_words(spark, str(tmp_path / "w.tsv")).withColumn("doc_id", F.lit(1))
    got = ocr_lines(words).orderBy("seg").collect()
    assert [(r.text, r.x0, r.x1, r.confidence) for r in got] == [('say "hi there', 10.0, 75.0, 85.0), ("apart", 300.0, 330.0, 95.0)]
    assert [r.text for r in ocr_lines(words, split=False).collect()] == ['say "hi there apart']


def test_json_documents(spark, tmp_path):
    doc = {"source": "s", "warnings": ["w"], "pages": [{"number": 1, "width": 10.0, "height": 20.0, "warnings": [], "blocks": [{"type": "figure", "text": "T", "bbox": [1, 2, 3, 4], "confidence": None, "metadata": {"chart_data": [{"type": "point", "panel_id": "a", "class": 2, "depth": 1.5}]}}]}]}
    golden = {"sample_id": "g", "required_terms": ["t"], "panels": [{"id": "a", "caption": "c", "predicted_intervals": [{"class": 1, "start_depth": 0, "end_depth": 2}], "predicted_points": [{"class": 2, "depth": 1.5}]}]}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "g.json").write_text(json.dumps(golden, indent=1))
    docs = jsondoc.read_json(spark, str(tmp_path / "d.json"), jsondoc.DOCUMENT)
    (b,) = jsondoc.blocks(docs).collect()
    assert (b.page_no, b.x0, b.y1, b.confidence) == (0, 1.0, 4.0, None)
    assert [r["class"] for r in jsondoc.chart_items(docs).collect()] == [2]
    assert jsondoc.texts(docs).first().text.startswith("w\nfigure\nt\n")
    goldens = jsondoc.read_json(spark, str(tmp_path / "g.json"), jsondoc.CHART_GOLDEN)
    assert jsondoc.expected_intervals(goldens).first().end_depth == 2.0 and jsondoc.expected_points(goldens).first()["class"] == "2"


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"f{i}.txt").write_text(f"Head {i}\n\nA body that ends here.")
    base = [str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--format", "both"]
    spark_stop = spark.stop
    assert convert.main([*base, "--dry-run"]) == 0 and capsys.readouterr().out.count("\n") == 3
    assert convert.main([*base, "--batch", "2"]) == 0 and capsys.readouterr().out.count("\n") == 2
    assert convert.main([*base, "--resume"]) == 0
    assert spark.read.parquet(str(tmp_path / "out" / "json")).count() == 3 and spark.read.parquet(str(tmp_path / "out" / "md")).count() == 3
    assert callable(spark_stop)


def test_scanned_page_end_to_end(spark):
    words = spark.createDataFrame([(1, 0, i, 1, 1, n, 60.0 + 50 * i, 100.0 + 20 * n, 45.0, 12.0, 90.0, w) for n in range(3) for i, w in enumerate(["some", "words", "here"])], "doc_id bigint, page_no int, word_seq int, block_num int, par_num int, line_num int, left double, top double, width double, height double, conf double, text string")
    got = convert.blocks_of_words(words, 612.0, 792.0).collect()
    assert [r.text for r in got] == ["some words here some words here some words here"]
