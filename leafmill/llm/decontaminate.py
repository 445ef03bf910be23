"""Benchmark decontamination by size-partitioned containment search (operator 4, native).

Items are short and documents long, so their Jaccard similarity is near 0 even
where a document holds the whole item; what is searched is containment, the
share of an item's distinct word shingles that a document has.  Items fall into
partitions by the power of two of their set size.  An item is represented by
its bottom-m MinHash sketch, where m, fixed for a partition by its largest
size, is one more than the shingles that a contained item may miss: any
document with the containment sought has at least one retained value, so no
leak is lost to the sketch.  Candidates are verified by counting the item's
shingles, as strings, in the whole document.

The sketches are broadcast while rows and bytes of the items' shingles stay
under scratch.BROADCAST_ROWS and BROADCAST_BYTES; beyond that they are joined
by a shuffle in which each value is spread over SALTS places, so that a value
which most documents hold is no task's alone.  Documents are read once for
candidates; only candidate documents are read for verification.

Cases: null and empty texts hold and are nothing; items under SHINGLE words are
one shingle, their whole word sequence; items with the same text are each
reported; empty tables give an empty one; rows that share a doc_id are searched
each and their shingles counted together, unless ``keys`` names more columns
that tell them apart; repeated rows are reported once; rows without doc_id or
item_id are left out; other columns are ignored.  A-Z count as a-z.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import BROADCAST_BYTES, BROADCAST_ROWS, Scratch, only, restrict

SHINGLE, CONTAINED, SALTS = 5, 50, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(folded, "[ \\t-\\r]+"), "")


def shingles(rows: DataFrame, keys: list[str], length: int, of) -> DataFrame:
    """(keys, s): every shingle of ``length`` words in ``words``, made by ``of`` from the word columns."""
    # The outer form, and no test of the size: either would be pushed down to the scan and split the text again.
    each = rows.select(*keys, "words", F.posexplode_outer("words").alias("pos", "w"))
    here = [F.get("words", F.col("pos") + i) for i in range(length)]
    return each.where(F.col("pos") <= F.size("words") - length).select(*keys, of(here).alias("s"))


def hashed(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def spelled(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def leaks(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None, percent: int = CONTAINED, size: int = SHINGLE, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of documents that hold ``percent`` of an item's shingles; documents are told apart by ``keys``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "leaks")
    texts = only(docs, *keys, "text").where("doc_id IS NOT NULL")
    asked = only(items, "item_id", "text").where("item_id IS NOT NULL").select("item_id", words("text").alias("words")).where(F.size("words") > 0)
    asked = scratch.save(asked.withColumn("width", F.least(F.size("words"), F.lit(size))), "items")
    out = None
    for width in sorted(r[0] for r in asked.select("width").distinct().collect()):  # at most ``size`` rows
        found = _of_width(texts, asked.where(F.col("width") == width), width, scratch, percent, list(keys))
        out = found if out is None else out.unionByName(found)
    none = texts.select(*keys, *[F.lit(0).cast("bigint").alias(c) for c in ("item_id", "n_shared", "n_item")]).limit(0)
    return out if out is not None else none


def _spread(rows: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with side on s by a shuffle, each s at SALTS places."""
    salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int")).join(salted, ["s", "salt"]).drop("salt")


def _of_width(texts: DataFrame, asked: DataFrame, width: int, scratch: Scratch, percent: int, keys: list[str]) -> DataFrame:
    own = shingles(asked, ["item_id"], width, spelled).distinct()
    sized = own.groupBy("item_id").agg(F.count("*").alias("n_item"))
    sized = sized.withColumn("partition", F.floor(F.log2("n_item")))
    bounds = sized.groupBy("partition").agg(F.max("n_item").alias("largest"))
    # A contained item of n shingles misses at most floor(n * (100 - percent) / 100); the partition's largest misses most.
    m = F.floor(F.col("largest") * (100 - percent) / 100) + 1
    sized = scratch.save(sized.join(bounds, "partition").select("item_id", "n_item", m.alias("m")), "sizes")
    values = shingles(asked, ["item_id"], width, hashed).groupBy("item_id").agg(F.sort_array(F.collect_set("s")).alias("h"))
    sketch = values.join(sized, "item_id").select("item_id", F.explode(F.slice("h", F.lit(1), F.col("m").cast("int"))).alias("s"))
    sketch = scratch.save(sketch, "sketches")
    own = scratch.save(own, "shingles")
    rows, size = own.agg(F.count("*"), F.sum(F.octet_length("s") + 64)).first()
    small = rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES
    meet = (lambda x, side: x.join(F.broadcast(side), "s")) if small else (lambda x, side: _spread(x, side, keys))
    split = lambda rows: rows.select(*keys, words("text").alias("words"))
    hits = meet(shingles(split(texts), keys, width, hashed), sketch).select(*keys, "item_id").distinct()
    hits = scratch.save(hits, "candidates")
    wanted = scratch.save(hits.select(*keys).distinct(), "wanted")
    # Only candidates are split into words again.
    some = split(restrict(texts, wanted, wanted.count(), keys))
    counted = meet(shingles(some, keys, width, spelled), own).select(*keys, "item_id", "s").distinct()
    counted = counted.groupBy(*keys, "item_id").agg(F.count("*").alias("n_shared"))
    sizes = sized.select("item_id", "n_item")
    final = counted.join(F.broadcast(sizes) if small else sizes, "item_id").where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
    return final.select(*keys, "item_id", "n_shared", "n_item")


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '')"
ORACLE = {
    "op4_benchmark_decontamination": f"""
        WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        i AS (SELECT item_id, least(5, len(w)) AS k, w FROM b WHERE len(w) > 0),
        s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM i)),
        n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY 1),
        d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        e AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i)),
        t AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM e),
        c AS (SELECT doc_id, item_id, count(*) AS n_shared FROM t JOIN s USING (k, s) GROUP BY 1, 2)
        SELECT doc_id, item_id, n_shared, n_item FROM c JOIN n USING (item_id) WHERE n_shared * 100 >= n_item * 50
    """
}
QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
