"""OCR words from tab-separated tables, one file a page or document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(source, page_no, word_seq, block_num, par_num, line_num, left, top, width, height, conf, text).

    Quotes are ordinary characters in these files; rows that are no words have a negative confidence.
    """
    raw = spark.read.schema(SCHEMA).option("sep", "\t").option("header", True).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return raw.select(
        F.input_file_name().alias("source"), (F.col("page_num") - 1).alias("page_no"), "word_num", "block_num", "par_num", "line_num", "left", "top", "width", "height", "conf", "text"
    ).withColumnRenamed("word_num", "word_seq")
