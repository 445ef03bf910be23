"""From files to outputs: the whole plan, and a thin command line over it."""

from __future__ import annotations

import argparse
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import formula
from leafmill.functions.text import classify_ocr
from leafmill.operators import charts, layout, lines, order, render, runtime, tables
from leafmill.operators.order import PAGE
from leafmill.sources import binary
from leafmill.sources.text import text_to_blocks

FORMATS = {"md": render.markdown, "txt": render.plain_text, "llm": render.compact, "llm-v1": render.legacy, "lean": render.lean, "rag": render.chunks}
ALL = ("md", "txt", "llm", "rag")
TEXTS = r"(?i)[.](txt|text|md)$"
NETPBM = r"(?i)[.]p[gp]m$"


@dataclass(frozen=True)
class Options:
    source: str | list[str]
    out: str
    format: str = "md"
    suffix: str = ""
    batch: int | None = None
    resume: bool = False
    dry_run: bool = False
    rag_size: int = 2000
    rag_ready: bool = False
    lang: str = "eng"
    force_ocr: bool = False
    min_confidence: float = 45.0
    chart_colors: str = "auto"
    recursive: bool = False
    per_file_dir: bool = False
    handwriting: bool = False
    deskew: bool = True
    formula_ocr: bool = False
    workers: int = 0
    no_batch: bool = False
    ocr_command: str | None = None

    @property
    def formats(self) -> tuple[str, ...]:
        """'both' is md and txt; 'all' leaves out the legacy and lean forms; retrieval chunks come on top where asked for."""
        own = {"both": ("md", "txt"), "all": ALL}.get(self.format, (self.format,))
        return own + ("rag",) * (self.rag_ready and "rag" not in own)

    @property
    def colors(self) -> list[str] | None:
        return None if self.chart_colors == "auto" else [c.strip() for c in self.chart_colors.split(",") if c.strip()]


def inputs(spark: SparkSession, options: Options) -> DataFrame:
    """Files (seq, path, doc_id, kind, content) to convert, those done left out and at most ``batch`` of them; kind: pdf, image, text or null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", options.recursive).load(options.source).select("path", "content")
    kind = F.when(F.col("path").rlike(NETPBM), "image").when(F.col("path").rlike(TEXTS), "text").otherwise(runtime.route(F.col("path")))
    files = files.dropDuplicates(["path"]).withColumns({"doc_id": F.xxhash64("path"), "seq": F.col("path"), "kind": kind})
    if options.resume:
        try:
            done = spark.read.parquet(f"{options.out}/json").select(F.col("stem"))
            files = runtime.pending(files, done, options.suffix)
        except Exception as error:  # noqa: BLE001 - nothing was written yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
    return runtime.first_files(files, options.batch) if options.batch else files


def blocks_of_texts(files: DataFrame) -> DataFrame:
    made = text_to_blocks(files.select("doc_id", "text")).withColumns({"page_no": F.lit(0), **{k: F.lit(None).cast("double") for k in ("x0", "y0", "x1", "y1")}})
    return order.default_order(made)


def blocks_of_words(words: DataFrame, width: float | Column, height: float | Column, min_confidence: float = 45.0, sizes: DataFrame | None = None) -> DataFrame:
    """Scanned pages: words to segments, paragraphs, layout and reading order; sizes: (doc_id, page_no, width, height) where pages differ."""
    segments = lines.ocr_lines(words, min_confidence).withColumn("block_seq", F.col("first_word"))
    merged = lines.merge_paragraphs(segments.withColumn("type", classify_ocr(F.col("text"))), ocr=True)
    return layout.enhance(merged if sizes is None else merged.join(sizes, PAGE), width, height)


def _shape(blocks: DataFrame) -> DataFrame:
    """The columns that renderers read, whatever made the blocks."""
    kinds = {"page_no": "int", "block_seq": "int", "pos": "int", "type": "string", "text": "string", "confidence": "double", **dict.fromkeys(("x0", "y0", "x1", "y1", "width", "height"), "double"), "chart": render.CHART}
    return blocks.select("doc_id", *[(F.col(c) if c in blocks.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def ruled_tables(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Table blocks of ruled grids, in place of blocks typed as tables on their pages; each grid is a page of its own while it is filled."""
    lot = F.col("page_no") * 1000 + F.col("table_id")
    grids = cells.select(*PAGE, "table_id").distinct()
    own = cells.select("doc_id", lot.alias("page_no"), "r", "c", "x0", "y0", "x1", "y1")
    near = blocks.join(grids, PAGE).withColumn("page_no", lot)
    place = own.groupBy(*PAGE).agg(*[F.min(k).alias(k) for k in ("x0", "y0")], *[F.max(k).alias(k) for k in ("x1", "y1")])
    made = tables.markdown(tables.grid_cells(near, own)).join(place, PAGE)
    made = made.select("doc_id", F.floor(F.col("page_no") / 1000).cast("int").alias("page_no"), (F.lit(100_000) + F.col("page_no") % 1000).cast("int").alias("block_seq"), F.lit("table").alias("type"), "text", "x0", "y0", "x1", "y1")
    with_grid = grids.select(*PAGE).distinct().withColumn("gridded", F.lit(True))
    kept = blocks.join(with_grid, PAGE, "left").where("gridded IS NULL OR type <> 'table'").drop("gridded")
    return kept.unionByName(made, allowMissingColumns=True)


def blocks_of_scans(pages: DataFrame, words: DataFrame, items: DataFrame, options: Options) -> DataFrame:
    """Blocks of pages of pixels: text by OCR, tables by ruled lines, charts by pixels, formulas rebuilt.

    Every page has a block: one that couldn't be read says so.
    """
    key = pages.select(F.xxhash64("path").alias("doc_id"), "page_no", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "error")
    sizes = key.where("error IS NULL").select(*PAGE, "width", "height")
    read = words.withColumn("doc_id", F.xxhash64("path"))
    blocks = _shape(blocks_of_words(read.where("error IS NULL"), F.col("width"), F.col("height"), options.min_confidence, sizes))
    blocks = ruled_tables(blocks, binary.table_grids(pages).withColumn("doc_id", F.xxhash64("path")))
    failed = read.where("error IS NOT NULL").groupBy(*PAGE).agg(F.first("error").alias("ocr_error"))
    silent = key.join(blocks.select(*PAGE).distinct(), PAGE, "left_anti").join(failed, PAGE, "left")
    reason = F.coalesce("error", "ocr_error")
    told = silent.select(
        *PAGE, "width", "height", F.lit(0).alias("block_seq"), F.when(reason.isNull(), "uncertain").otherwise("figure").alias("type"),
        F.when(reason.isNull(), "This page has no text that could be read.").otherwise(F.concat(F.lit("This page was not read: "), reason)).alias("text"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.coalesce("width", F.lit(0.0)).alias("x1"), F.coalesce("height", F.lit(0.0)).alias("y1"), F.lit(0.0).alias("confidence"),
    )
    whole = _shape(blocks.unionByName(told, allowMissingColumns=True)).drop("chart")
    return _numbered(charts.attach_to_figures(whole, items.withColumn("doc_id", F.xxhash64("path"))))


def blocks_of_pdfs(spans: DataFrame) -> DataFrame:
    """Native pages: spans to lines, paragraphs, layout and reading order, and a figure for each image."""
    named = spans.withColumn("doc_id", F.xxhash64("path"))
    sizes = named.groupBy(*PAGE).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    merged = lines.merge_paragraphs(lines.assemble_spans(named)).join(sizes, PAGE)
    own = _shape(layout.enhance(merged, F.col("width"), F.col("height")))
    pictures = binary.image_placeholders(spans).withColumns({"doc_id": F.xxhash64("path"), "block_seq": F.lit(200_000)})
    return _numbered(own.unionByName(_shape(pictures.join(sizes, PAGE, "left"))))


def _numbered(blocks: DataFrame) -> DataFrame:
    """pos anew where blocks came after the reading order was found: they go to the end of their page. Formulas are rebuilt."""
    from pyspark.sql import Window

    walk = Window.partitionBy(*PAGE).orderBy(F.coalesce("pos", F.lit(1 << 30)), "block_seq", F.coalesce("y0", F.lit(0.0)))
    text = F.when(F.col("type") == "formula", formula.rebuild(F.col("text"))).otherwise(F.col("text"))
    return _shape(blocks.withColumns({"pos": F.row_number().over(walk), "text": text}))


def blocks_of(spark: SparkSession, files: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Blocks of all files, and the run's warnings (path, warning, fatal). Pages of pixels are drawn once, to a table beside the outputs."""
    told = lambda d, fatal: d.where("error IS NOT NULL").select("path", F.col("error").alias("warning"), F.lit(fatal).alias("fatal"))
    whole = files.where("kind = 'text'").select("doc_id", F.decode("content", "UTF-8").alias("text"))
    parts, warnings = [_shape(blocks_of_texts(whole))], []
    kinds = {r[0] for r in files.select("kind").distinct().collect()}  # four at most
    scans = []
    if "pdf" in kinds:
        spans = binary.pdf_spans(files)
        text = binary.native(spans).where(F.lit(not options.force_ocr))
        parts.append(blocks_of_pdfs(text))
        warnings.append(told(spans, False))  # such a file is drawn
        drawn = files.join(text.select("path").distinct(), "path", "left_anti")
        scans.append(binary.rendered(drawn, handwriting=options.handwriting))
    if "image" in kinds:
        scans.append(binary.images(files.where("kind = 'image'"), options.deskew, options.handwriting))
    if scans:
        at = f"{options.out}/_pages"
        reduce(DataFrame.unionByName, scans).write.mode("overwrite").parquet(at)
        pages = spark.read.parquet(at)
        words = binary.ocr(pages, options.lang, 7 if options.handwriting else None, command=options.ocr_command)
        words.write.mode("overwrite").parquet(f"{options.out}/_words")
        words = spark.read.parquet(f"{options.out}/_words")
        parts.append(blocks_of_scans(pages, words, binary.chart_pages(files, options.colors, options.deskew), options))
        warnings += [told(pages, True), told(words, False)]
    odd = files.where("kind IS NULL").select("path", F.lit("unsupported type of file").alias("warning"), F.lit(True).alias("fatal"))
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, warnings, odd)


def convert(spark: SparkSession, options: Options) -> DataFrame:
    """Writes one table a format under ``out``, JSON and the run's status always; gives the files it took with their status.

    A file that fails is a row of the status with its warnings, and no other is affected.
    """
    files = inputs(spark, options)
    if options.dry_run:
        return files.select("path")
    stem = F.concat(runtime.stem(F.col("path")), F.lit(options.suffix)).alias("stem")
    target = runtime.output_path(F.lit(options.out), F.col("path"), options.suffix, "", options.per_file_dir).alias("target")
    named = files.select("doc_id", "path", stem, target)
    blocks, warnings = blocks_of(spark, files, options)
    blocks.write.mode("overwrite").parquet(f"{options.out}/_blocks")
    blocks = spark.read.parquet(f"{options.out}/_blocks")
    for name in options.formats:
        made = render.chunks(blocks, options.rag_size) if name == "rag" else FORMATS[name](blocks)
        made.join(named, "doc_id").write.mode("append").parquet(f"{options.out}/{name}")
    told = warnings.groupBy("path").agg(F.sort_array(F.collect_set("warning")).alias("warnings"), F.bool_or("fatal").alias("fatal"))
    spoken = blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"))
    status = named.join(told, "path", "left").join(spoken, "doc_id", "left")
    rc = F.when(F.col("n_blocks").isNull() | F.coalesce("fatal", F.lit(False)), 1).otherwise(0).alias("rc")
    status = status.select("path", rc, F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"))
    status.write.mode("append").parquet(f"{options.out}/status")
    render.json_documents(blocks).join(named, "doc_id").write.mode("append").parquet(f"{options.out}/json")
    return status


def parser() -> argparse.ArgumentParser:
    found = argparse.ArgumentParser(prog="leafmill", description="Texts, PDFs and images to structured documents")
    found.add_argument("source", nargs="+")
    found.add_argument("--out", default="outputs")
    found.add_argument("--format", default="md", choices=[*FORMATS, "both", "all"])
    found.add_argument("--suffix", "--output-suffix", default="", dest="suffix")
    found.add_argument("--batch", "--batch-size", type=int, dest="batch")
    found.add_argument("--rag-size", "--chunk-size", type=int, default=2000, dest="rag_size")
    found.add_argument("--lang", default="eng")
    found.add_argument("--min-confidence", type=float, default=45.0)
    found.add_argument("--chart-colors", default="auto")
    found.add_argument("--ocr-command")
    found.add_argument("--workers", "-w", type=int, default=0)
    found.add_argument("--recursive", "-r", action="store_true")
    for name in ("resume", "dry-run", "rag-ready", "force-ocr", "per-file-dir", "handwriting", "formula-ocr", "no-batch"):
        found.add_argument(f"--{name}", action="store_true")
    found.add_argument("--deskew", action=argparse.BooleanOptionalAction, default=True)
    return found


def main(arguments: list[str] | None = None) -> int:
    options = Options(**vars(parser().parse_args(arguments)))
    builder = SparkSession.builder.appName("leafmill")
    if options.workers or options.no_batch:  # of use where no cluster runs the plan
        builder = builder.master(f"local[{1 if options.no_batch else options.workers}]")
    failed = 0
    for row in convert(builder.getOrCreate(), options).toLocalIterator():
        print(row.path)
        failed += 0 if options.dry_run else row.rc
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
