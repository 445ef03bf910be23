"""Texts that keep arriving: the batch plan over a file stream.

The plan is stateless, so a stream over files gives what a batch over the
same files gives; the checkpoint remembers which files are done, as resuming
does for batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmill.sources.text import text_to_blocks

SCHEMA = "doc_id bigint, text string"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).json(folder)


def blocks_from(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int = 100, once: bool = True) -> StreamingQuery:
    """Blocks of arriving documents (JSON lines) as Parquet; with ``once`` what is there is done and the query ends."""
    query = text_to_blocks(arriving(spark, folder, files_a_batch)).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()


def paragraphs_by_arrival(spark: SparkSession, folder: str, delay: str = "10 minutes", window: str = "5 minutes", files_a_batch: int = 100) -> DataFrame:
    """Documents and paragraphs by time windows of the files' arrival (column ts in the files), late ones up to ``delay``."""
    docs = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", files_a_batch).json(folder).withWatermark("ts", delay)
    sized = docs.select("ts", F.size(F.split(F.coalesce("text", F.lit("")), r"\n\s*\n+")).alias("n"))
    return sized.groupBy(F.window("ts", window)).agg(F.count("*").alias("documents"), F.sum("n").alias("paragraphs"))
