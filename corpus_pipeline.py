"""The corpus pipeline: documents are judged, deduplicated, decontaminated and packed.

Each stage takes documents and all but the last return documents with the
columns they came with, whatever these are called.  A stage that drops rows
names them by doc_id and a digest of the text in a small table of the shared
folder and takes them off its input by an anti join: broadcast while they are
few, shuffled beyond that.  That table lives until ``run`` has written the
stage's result, or until the process ends where stages are called by
themselves, so stages compose lazily.

Cases: null and empty texts are texts like others and copies of one another;
very long ones are read whole; every row is a document of its own: rows that
share a doc_id are judged by their own texts, and of rows that agree in doc_id
and text one stays where copies are dropped; of equal texts the largest
doc_id stays, of near copies the smallest; rows without doc_id can't be named,
pass through the stages that drop, and are left out by packing; empty tables
give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from leafmill.llm.scratch import BROADCAST_ROWS, Scratch, broadcast


def _sha(text: Column) -> Column:
    """As exact_dedup's text_sha256: a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _without(docs: DataFrame, dropped: DataFrame, own: Scratch, name: str, digest: Column) -> DataFrame:
    """docs without the rows whose doc_id and digest, a column of that name in dropped, are named there."""
    ids = own.save(dropped.select("doc_id", name).distinct(), "dropped")
    same = (docs["doc_id"] == ids["doc_id"]) & (digest == ids[name])
    return docs.join(broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, same, "left_anti").select(*docs.columns)


def _repeated(docs: DataFrame, own: Scratch) -> tuple[DataFrame, int]:
    """doc_ids of several rows, and how many there are."""
    again = own.save(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "ids")
    return again, again.count()


def _once(docs: DataFrame, again: DataFrame, n: int) -> DataFrame:
    """docs with one of the rows that agree in doc_id and text; only rows of repeated doc_ids are shuffled for it."""
    if not n:
        return docs
    keys = broadcast(again) if n <= BROADCAST_ROWS else again
    repeated = docs.join(keys, "doc_id", "left_semi").select(*docs.columns, _sha(docs["text"]).alias("_text_digest"))
    return docs.join(keys, "doc_id", "left_anti").select(*docs.columns).unionByName(repeated.dropDuplicates(["doc_id", "_text_digest"]).drop("_text_digest"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str, own: Scratch | None = None) -> DataFrame:
    work = Scratch(spark, "quality")
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), work)
    work.drop()
    return quality.keep_good(docs, net)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, own: Scratch | None = None) -> DataFrame:
    work, own = Scratch(spark, "copies"), own or Scratch(spark, "copies-ids")
    named = exact_dedup.exact_dedup(docs, work).where("NOT kept")
    again, n = _repeated(docs, own)
    kept = _once(_without(docs, named, own, "text_sha256", _sha(docs["text"])), again, n)
    work.drop()
    return kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, own: Scratch | None = None) -> DataFrame:
    work, own = Scratch(spark, "near"), own or Scratch(spark, "near-ids")
    rows = near_dedup.near_rows(docs, work)
    again, n = _repeated(docs, own)
    dropped = rows.where("doc_id <> component_id")
    if n:
        # Of several rows of one doc_id in one group one text stays.
        some = rows.where("doc_id = component_id AND n_shingles > 0").join(broadcast(again) if n <= BROADCAST_ROWS else again, "doc_id", "left_semi")
        first = some.groupBy("component").agg(F.min("text_hash").alias("first"))
        dropped = dropped.select("doc_id", "text_hash").unionByName(some.join(first, "component").where("text_hash <> first").select("doc_id", "text_hash"))
    kept = _once(_without(docs, dropped, own, "text_hash", F.xxhash64(docs["text"])), again, n)
    work.drop()
    return kept


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str, own: Scratch | None = None) -> DataFrame:
    work, own = Scratch(spark, "leaks"), own or Scratch(spark, "leaks-ids")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named = decontaminate.leaks(docs.select("doc_id", "text", F.xxhash64(docs["text"]).alias("text_hash")), items, work, keys=("doc_id", "text_hash"))
    kept = _without(docs, named, own, "text_hash", F.xxhash64(docs["text"]))
    work.drop()
    return kept


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str, own: Scratch | None = None) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", reject_poor),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
#: SQL can't state a trained network; the pipeline is tested against a brute-force version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: DataFrame | None = None
    for name, stage in STAGES:
        own = Scratch(spark, "stage")
        result = kept.save(stage(spark, docs, sf_dir, own), name.replace(" ", "-"))
        own.drop()
        if before is not None:
            kept.drop(before)
        docs = before = result
    return docs
