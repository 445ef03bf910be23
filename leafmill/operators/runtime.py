"""What to run, how it went, and two OCR engines as one."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.operators.order import PAGE

SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def route(path: Column) -> Column:
    """pdf, image or, for anything else, null."""
    suffix = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(*SUFFIXES[1:]), "image")


def supported(files: DataFrame) -> DataFrame:
    """Files (path, seq) of known types, the first of equal paths."""
    first = files.groupBy("path").agg(F.min("seq").alias("seq"))
    return first.withColumn("kind", route(F.col("path"))).where("kind IS NOT NULL")


def output_path(folder: Column, source: Column, suffix: str = "", extension: str = ".json", per_file: bool = False) -> Column:
    own = stem(source)
    place = F.concat(folder, F.lit("/"), own) if per_file else folder
    return F.concat(place, F.lit("/"), own, F.lit(suffix + extension))


def pending(files: DataFrame, done: DataFrame, suffix: str = "") -> DataFrame:
    """Files (path, ...) for whose stem and suffix there is no output (stem)."""
    return files.withColumn("stem", F.concat(stem(F.col("path")), F.lit(suffix))).join(done.select("stem").distinct(), "stem", "left_anti")


def first_files(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy("seq").limit(n)


def ocr_mode(lang: Column, aspect: Column) -> Column:
    """The page segmentation mode: 6 for CJK languages, 4 for very wide or tall images, else 3."""
    return F.when(lang.isin("chi_sim", "chi_sim+eng", "chi_tra", "jpn", "jpn_vert", "kor"), 6).when((aspect > 2.0) | (aspect < 0.4), 4).otherwise(3)


def auto_language(is_cjk: Column, script: Column, min_confidence: Column) -> Column:
    """lang, min_confidence and psm where the language is asked to be found; a confidence other than 45 stays."""
    cjk = F.coalesce(is_cjk, F.lit(False)) | F.coalesce(F.lower(script).isin("chinese", "cjk", "han", "hans", "hant", "japanese", "korean"), F.lit(False))
    confidence = F.when(min_confidence != 45.0, min_confidence).when(cjk, 35.0).otherwise(40.0)
    return F.struct(F.when(cjk, "chi_sim").otherwise("chi_sim+eng").alias("lang"), confidence.alias("min_confidence"), F.when(cjk, 6).otherwise(3).alias("psm"))


def run_summary(status: DataFrame) -> DataFrame:
    """One row of a run's status (path, rc, warnings, seconds): ok, fail and files a second."""
    return status.agg(F.count_if(F.col("rc") == 0).alias("ok"), F.count_if(F.col("rc") != 0).alias("fail"), (F.count("*") / F.nullif(F.sum("seconds"), F.lit(0.0))).alias("files_per_second"))


def duration(seconds: Column) -> Column:
    s = F.bround(seconds).cast("bigint")
    m, h = F.floor(s / 60) % 60, F.floor(s / 3600)
    clock = F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%02d:%02d", m, s % 60))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds <= 0), "--:--").otherwise(clock)


def placed(first: list[tuple], second: list[tuple]) -> list[int]:
    """What a page shows of two engines' blocks (x0, y0, x1, y1, confidence): a place of the first, or len(first) and on of the second."""
    boxes = np.array([[np.nan if v is None else v for v in b] for b in (*first, *second)], float).reshape(-1, 5)
    n = len(first)
    out = list(range(n))
    held = np.full((len(boxes), 5), np.nan)
    held[:n] = boxes[:n]
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    for j in range(n, len(boxes)):
        b, best, at = boxes[j], 0.0, -1
        if n and not np.isnan(b[0]):
            own = held[: len(out)]
            w = np.minimum(own[:, 2], b[2]) - np.maximum(own[:, 0], b[0])
            h = np.minimum(own[:, 3], b[3]) - np.maximum(own[:, 1], b[1])
            least = np.minimum(area(own), area(b))
            fits = (w > 0) & (h > 0) & (least > 0)
            share = np.where(fits, w * h / np.where(fits, least, 1.0), 0.0)
            at = int(share.argmax())
            best = float(share[at])
        if best <= 0.5:
            held[len(out)] = b
            out.append(j)
        elif np.nan_to_num(b[4]) > np.nan_to_num(held[at, 4]):
            held[at], out[at] = b, j
    return out


def merge_engines(first: DataFrame, second: DataFrame) -> DataFrame:
    """Blocks of two OCR engines (doc_id, page_no, block_seq, text, x0..y1, confidence) as one list a page.

    A block of the second engine takes the place of the one it overlaps most,
    by over half of the smaller area, if it is surer; else it goes at the end,
    where later blocks can meet it. Order matters, so each page is one fold;
    pages are gathered by the JVM, and only boxes are handed over, many pages
    at a time.
    """
    cols = ["block_seq", "text", "x0", "y0", "x1", "y1", "confidence", "engine"]
    box = ("x0", "y0", "x1", "y1", "confidence")

    @F.pandas_udf("array<int>")
    def order(*sides: pd.Series) -> pd.Series:
        pages = zip(*sides, strict=True)
        rows = lambda columns: [] if columns[0] is None else list(zip(*columns, strict=True))
        return pd.Series([placed(rows(page[:5]), rows(page[5:])) for page in pages])

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))

    met = gathered(first, "a").join(gathered(second, "b"), PAGE, "full")
    none = F.array().cast(met.schema["a"].dataType)
    met = met.withColumns({"a": F.coalesce("a", none), "b": F.coalesce("b", none.cast(met.schema["b"].dataType))})
    field = lambda side, k: F.transform(side, lambda b: b[k].cast("double"))
    fields = [field(side, k) for side in ("a", "b") for k in box]
    shown = met.select(*PAGE, F.concat("a", "b").alias("both"), F.posexplode(order(*fields)).alias("block_seq", "i"))
    return shown.select(*PAGE, "block_seq", *[F.get("both", F.col("i"))[c].alias(c) for c in cols[1:]])
