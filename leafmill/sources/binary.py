"""Files of pages: discovery, images, PDFs, OCR, and pixel operators over them.

Decoding and OCR need optional libraries or a binary (Pillow, pypdf,
tesseract); without them a page comes back with an error in its status, never
silently empty. Netpbm images need nothing. Work is by page: a document's
pages are rows of their own before anything slow is done.
"""

from __future__ import annotations

import os
import shutil
import subprocess
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import raster
from leafmill.operators import charts
from leafmill.operators.runtime import ocr_mode, route

IMAGES = "path string, page_no int, width int, height int, pixels binary, error string"
SPANS = "path string, page_no int, span_seq int, x double, y double, font_size double, text string, width double, height double, n_images int, error string"
WORDS = "path string, page_no int, word_seq int, block_num int, par_num int, line_num int, left double, top double, width double, height double, conf double, text string, error string"
OCR_SECONDS = 120
#: Tasks among which the pages of a PDF are dealt out.
RENDER_LOTS = 4


def discover(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files of known types under a path, each once: path, kind, length, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    return files.select("path", "modificationTime", "length", "content").withColumn("kind", route(F.col("path"))).where("kind IS NOT NULL OR lower(path) RLIKE '[.]p[gp]m$'").dropDuplicates(["path"])


def decode(content: bytes) -> np.ndarray:
    """An RGB image from a file's bytes, its orientation applied."""
    if content[:2] in (b"P5", b"P6"):
        head, at = [], 2
        while len(head) < 3:
            while content[at : at + 1].isspace():
                at += 1
            if content[at : at + 1] == b"#":
                at = content.index(b"\n", at)
                continue
            end = at
            while end < len(content) and not content[end : end + 1].isspace():
                end += 1
            if end == at:
                raise ValueError("the header ends early")
            head.append(int(content[at:end]))
            at = end
        w, h, top = head
        if top > 255:
            raise ValueError("only one byte a sample")
        flat = np.frombuffer(content, np.uint8, offset=at + 1)
        return flat[: w * h * 3].reshape(h, w, 3) if content[:2] == b"P6" else np.repeat(flat[: w * h].reshape(h, w, 1), 3, axis=2)
    import io

    from PIL import Image, ImageOps

    return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(content))).convert("RGB"))


def prepare(image: np.ndarray, handwriting: bool = False) -> np.ndarray:
    """Grey, stretched between its 2nd and 98th percentile, and smoothed by a median of nine; handwriting is parted locally from its ground."""
    g = raster.grey(image).astype(float)
    low, high = np.percentile(g, (2, 98))
    g = np.clip((g - low) / max(high - low, 1) * 255, 0, 255)
    p = np.pad(g, 1, mode="edge")
    g = np.median([p[i : i + g.shape[0], j : j + g.shape[1]] for i in range(3) for j in range(3)], axis=0)
    if handwriting:
        n = 15
        s = np.pad(np.cumsum(np.cumsum(np.pad(g, n, mode="edge"), 0), 1), ((1, 0), (1, 0)))
        k = 2 * n + 1
        mean = (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2
        g = np.where(g < mean - 10, 0, 255)
    return g.astype(np.uint8)


def rotate(image: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned about its middle, white where nothing was; quarter turns keep every pixel."""
    if degrees % 90 == 0:
        return np.rot90(image, int(degrees // 90))
    h, w = image.shape[:2]
    t = np.radians(degrees)
    y, x = np.mgrid[:h, :w]
    sx = np.round((x - w / 2) * np.cos(t) - (y - h / 2) * np.sin(t) + w / 2).astype(int)
    sy = np.round((x - w / 2) * np.sin(t) + (y - h / 2) * np.cos(t) + h / 2).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full_like(image, 255)
    out[inside] = image[sy[inside], sx[inside]]
    return out


def images(files: DataFrame, deskew: bool = True, handwriting: bool = False) -> DataFrame:
    """Image files (path, content) as grey pages, straightened."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    page = decode(content)
                    if deskew and (angle := raster.skew(page)):
                        page = rotate(page, angle)
                    page = prepare(page, handwriting)
                    rows.append((path, 0, page.shape[1], page.shape[0], page.tobytes(), None))
                except Exception as error:  # noqa: BLE001 - a bad file is a row of the run's status
                    rows.append((path, 0, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "page_no", "width", "height", "pixels", "error"]).astype({"width": "Int32", "height": "Int32"})

    return files.select("path", "content").mapInPandas(work, IMAGES)


def pdf_spans(files: DataFrame) -> DataFrame:
    """Positioned spans of native PDFs; a page without text is a row without one, an unreadable file one with an error."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    import io

                    from pypdf import PdfReader

                    for n, page in enumerate(PdfReader(io.BytesIO(content)).pages):
                        w, h = float(page.mediabox.width), float(page.mediabox.height)
                        spans: list[tuple] = []
                        page.extract_text(visitor_text=lambda t, _cm, tm, _f, size, s=spans, h=h: s.append((float(tm[4]), h - float(tm[5]), float(size or 0), " ".join(t.split()))) if t.split() else None)
                        pictures = len(getattr(page, "images", []))
                        rows += [(path, n, i, *s, w, h, pictures, None) for i, s in enumerate(spans)] or [(path, n, None, None, None, None, None, w, h, pictures, None)]
                except Exception as error:  # noqa: BLE001 - a bad file is a row of the run's status
                    rows.append((path, None, None, None, None, None, None, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")]).astype({"page_no": "Int32", "span_seq": "Int32", "n_images": "Int32"})

    return files.where("kind = 'pdf'").select("path", "content").mapInPandas(work, SPANS)


def native(spans: DataFrame) -> DataFrame:
    """Spans of those documents that have text and no glyph that failed to decode; the others go to OCR as a whole."""
    bad = spans.groupBy("path").agg(F.bool_or(F.coalesce(F.col("text").rlike("[□�]"), F.lit(False))).alias("tofu"), F.count("text").alias("n")).where("tofu OR n = 0")
    return spans.join(bad.select("path"), "path", "left_anti").where("text IS NOT NULL")


def image_placeholders(spans: DataFrame) -> DataFrame:
    """One figure block for each image embedded in a page."""
    pages = spans.where("n_images > 0").groupBy("path", "page_no").agg(F.max("n_images").alias("n"))
    each = pages.select("path", "page_no", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return each.select("path", "page_no", F.lit("figure").alias("type"), F.format_string("Embedded image %d, not described without OCR.", F.col("i")).alias("text"))


def ocr_binary() -> str | None:
    return os.environ.get("TESSERACT_CMD") or shutil.which("tesseract")


def ocr(pages: DataFrame, lang: str = "eng", psm: int | None = None, whitelist: str = "", command: str | None = None) -> DataFrame:
    """Words of grey pages by the OCR binary, fed through a pipe, with a time limit a page; psm by language and shape unless given."""
    mode = ocr_mode(F.lit(lang), F.col("width") / F.col("height")) if psm is None else F.lit(psm)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        names = [c.split()[0] for c in WORDS.split(", ")]
        binary = command or ocr_binary()
        for part in parts:
            rows = []
            for path, page, w, h, pixels, mode in part[["path", "page_no", "width", "height", "pixels", "mode"]].itertuples(index=False):
                try:
                    if binary is None:
                        raise FileNotFoundError("no OCR binary")
                    line = [binary, "stdin", "stdout", "-l", lang, "--psm", str(mode), *(["-c", f"tessedit_char_whitelist={whitelist}"] if whitelist else []), "tsv"]
                    done = subprocess.run(line, input=b"P5 %d %d 255\n" % (w, h) + pixels, capture_output=True, timeout=OCR_SECONDS, check=True)
                    for i, r in enumerate(csv.DictReader(io.StringIO(done.stdout.decode("utf-8", "replace")), delimiter="\t", quoting=csv.QUOTE_NONE)):
                        if (r.get("text") or "").strip():
                            rows.append((path, page, i, *(int(r[k]) for k in ("block_num", "par_num", "line_num")), *(float(r[k]) for k in ("left", "top", "width", "height", "conf")), r["text"], None))
                except Exception as error:  # noqa: BLE001 - a page that fails is a row of the run's status
                    rows.append((path, page, *[None] * 10, f"{type(error).__name__}: {error}"))
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({k: "Int32" for k in ("page_no", "word_seq", "block_num", "par_num", "line_num")} | {k: "Float64" for k in ("left", "top", "width", "height", "conf")})

    return pages.where("error IS NULL").withColumn("mode", mode).mapInPandas(work, WORDS)


def rendered(files: DataFrame, scale: float = 2.0, handwriting: bool = False) -> DataFrame:
    """Pages of PDFs as grey images, for those without native text; a file that can't be drawn is one row with an error.

    Files are dealt out by page range, so that one long document isn't one task.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content, lot in zip(part["path"], part["content"], part["lot"], strict=True):
                rows = []
                try:
                    import pypdfium2

                    book = pypdfium2.PdfDocument(content)
                    for n in range(int(lot), len(book), RENDER_LOTS):
                        page = np.asarray(book[n].render(scale=scale).to_numpy())
                        if angle := raster.skew(page):
                            page = rotate(page, angle)
                        page = prepare(page, handwriting)
                        rows.append((path, n, page.shape[1], page.shape[0], page.tobytes(), None))
                except Exception as error:  # noqa: BLE001 - a bad file is a row of the run's status
                    rows = [(path, 0, None, None, None, f"{type(error).__name__}: {error}")] if lot == 0 else []
                yield pd.DataFrame(rows, columns=["path", "page_no", "width", "height", "pixels", "error"]).astype({"page_no": "Int32", "width": "Int32", "height": "Int32"})

    lots = files.where("kind = 'pdf'").select("path", "content", F.explode(F.sequence(F.lit(0), F.lit(RENDER_LOTS - 1))).alias("lot"))
    return lots.mapInPandas(work, IMAGES)


_ITEMS = (
    "path string, page_no int, seq int, item_type string, panel_id string, class int, class_candidates array<int>, start_depth double, end_depth double, depth double, "
    "depth_tolerance double, color string, source string, px0 double, py0 double, px1 double, py1 double"
)


def chart_pages(files: DataFrame, names: list[str] | None = None, deskew: bool = True) -> DataFrame:
    """Chart items of image files: by colour, merged and deduplicated, else axis frames; zones beside them."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = [c.split()[0] for c in _ITEMS.split(", ")]
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    page = decode(content)
                    if deskew and (angle := raster.skew(page)):
                        page = rotate(page, angle)
                    items = ({"path": path, "page_no": 0, "seq": i, **item} for i, item in enumerate(raster.chart_items(page, names)))
                    rows += [[item.get(f) for f in fields] for item in items]
                except Exception:  # noqa: BLE001, S112 - the same file fails in images(), which reports it
                    continue
            frame = pd.DataFrame(rows, columns=fields, dtype=object)
            yield frame.astype({"page_no": "Int32", "seq": "Int32", "class": "Int32", **{k: "Float64" for k in fields if "depth" in k or k[0] == "p" and k[-1].isdigit()}})

    found = files.where("kind IS NULL OR kind = 'image'").select("path", "content").mapInPandas(work, _ITEMS)
    keys = ("path", "page_no", "panel_id", "class", "color")
    place = found.groupBy(*keys).agg(F.min("seq").alias("first"))
    own = charts.deduplicate(found.where("source = 'color'"), keys).drop("seq", "source", "px0", "py0", "px1", "py1")
    own = own.join(place, list(keys)).withColumns({"seq": F.col("first"), "source": F.lit("color")}).drop("first")
    every = own.unionByName(found.where("source <> 'color'"), allowMissingColumns=True)
    order = Window.partitionBy("path", "page_no").orderBy("seq", "item_type", F.coalesce("start_depth", "depth"))
    return every.withColumn("seq", F.row_number().over(order) - 1)


def chart_structures(pages: DataFrame) -> DataFrame:
    """Axis frames on pages of pixels, as chart items of type chart_detected."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, page, w, h, pixels in part[["path", "page_no", "width", "height", "pixels"]].itertuples(index=False):
                for s in raster.structures(np.frombuffer(pixels, np.uint8).reshape(h, w)):
                    rows.append((path, page, "chart_detected", *map(float, s["box"]), s["h_lines"], s["v_lines"]))
            yield pd.DataFrame(rows, columns=["path", "page_no", "item_type", "px0", "py0", "px1", "py1", "h_lines", "v_lines"])

    return pages.where("error IS NULL").mapInPandas(work, "path string, page_no int, item_type string, px0 double, py0 double, px1 double, py1 double, h_lines int, v_lines int")


def table_grids(pages: DataFrame) -> DataFrame:
    """Cells of ruled tables on pages of pixels: table_id, r, c, rowspan, colspan, x0..y1; spanned cells are left out."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, page, w, h, pixels in part[["path", "page_no", "width", "height", "pixels"]].itertuples(index=False):
                for t, grid in enumerate(raster.ruled_tables(np.frombuffer(pixels, np.uint8).reshape(h, w))):
                    spans = {(m["row"], m["col"]): (m["rowspan"], m["colspan"]) for m in grid["merged"]}
                    hidden = {(r + i, c + j) for (r, c), (a, b) in spans.items() for i in range(a) for j in range(b)} - set(spans)
                    for r in range(len(grid["rows"]) - 1):
                        for c in range(len(grid["cols"]) - 1):
                            if (r, c) not in hidden:
                                down, across = spans.get((r, c), (1, 1))
                                rows.append((path, page, t, r, c, down, across, *map(float, (grid["cols"][c], grid["rows"][r], grid["cols"][c + across], grid["rows"][r + down]))))
            yield pd.DataFrame(rows, columns=["path", "page_no", "table_id", "r", "c", "rowspan", "colspan", "x0", "y0", "x1", "y1"])

    return pages.where("error IS NULL").mapInPandas(work, "path string, page_no int, table_id int, r int, c int, rowspan int, colspan int, x0 double, y0 double, x1 double, y1 double")
