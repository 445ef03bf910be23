"""Exact deduplication by deterministic block naming (operator 10, native).

Texts are cut into blocks of fixed size.  Distinct blocks are sorted, by
(hash, bytes), into integer names; then names of adjacent blocks are paired,
and distinct pairs are sorted into names again, until each document has one
name.  Two documents of one block count share their name exactly if their
bytes agree: no step trusts a hash.

Only the first sort needs bytes.  It aggregates blocks before the shuffle, so
a block that a third of all documents share is moved once a map task.  What
goes back to the documents are numbers.  Names that more than a bounded
number of rows carry go back by broadcast, the rest by a shuffled join.

Cases: a null text counts as empty; empty texts equal one another; an empty
table gives an empty one; every row is a document of its own: repeated rows
each count, have a row in the result and stay or go together, and texts that
share a doc_id are told apart; rows without doc_id are no documents and are
left out; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch, only

BLOCK_BYTES = 16384
#: Names with more rows than this share of all rows are joined back by broadcast.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def weigh(names: DataFrame) -> tuple[int, int]:
    """The rows that names (with ``n`` rows each) stand for, and the most of one."""
    total, most = names.agg(F.sum("n"), F.max("n")).first()
    return total or 0, most or 0


def attach(rows: DataFrame, names: DataFrame, keys: list[str], weight: tuple[int, int]) -> DataFrame:
    """Inner join rows with names (one row per key, with its ``n`` of rows) on null-free keys.

    Keys with over 1 / HOT_SHARE of all rows, of which there are fewer than
    HOT_SHARE by counting, go by broadcast; no other key is large enough to
    skew. Where no key is hot the join is a plain one.
    """
    n_rows, most = weight
    limit = max(HOT_LEAST, n_rows // HOT_SHARE)
    if most <= limit:
        return rows.join(names.drop("n"), keys)
    hot = F.broadcast(names.where(F.col("n") > limit).drop("n"))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(names.where(F.col("n") <= limit).drop("n"), keys)
    return rest.unionByName(rows.join(hot, keys).select(*rest.columns))


def named(groups: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number distinct rows in sorted order: increasing integers, not without gaps."""
    return groups.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id())


def block_identity(docs: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64) -> DataFrame:
    """(doc_id, text_key, n_blocks, name, text_sha256, copies) of each document; copies: rows that agree in doc_id and text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    texts = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("raw", raw)
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / block_bytes)).cast("int")

    def block(i: Column) -> Column:
        return F.substring(F.col("raw"), i * block_bytes + 1, F.lit(block_bytes))

    blocks = F.transform(F.sequence(F.lit(0), count - 1), block)
    hashes = F.transform(blocks, lambda b: hash_of(b))
    marked = scratch.save(
        texts.select("doc_id", F.sha2("raw", 256).alias("text_sha256"), hashes.alias("hashes"), F.size(hashes).alias("n_blocks"))
        .withColumn("text_key", F.xxhash64("hashes", "text_sha256")).groupBy("doc_id", "text_key", "text_sha256")
        .agg(F.first("hashes").alias("hashes"), F.first("n_blocks").alias("n_blocks"), F.count("*").alias("copies")),
        "documents",
    )
    occurrences = marked.select("doc_id", "text_key", "n_blocks", F.posexplode("hashes").alias("pos", "h"))

    # The only shuffle of bytes: distinct blocks, combined in the map tasks.
    distinct = scratch.save(texts.select(F.explode(blocks).alias("b")).select(hash_of(F.col("b")).alias("h"), "b").groupBy("h", "b").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")), "blocks")
    weight = weigh(distinct)
    clash = distinct.where("kinds > 1").select("h")
    if clash.isEmpty():
        placed = occurrences.withColumn("r", F.lit(0))
    else:
        # Different blocks share a hash: for those alone the bytes are sorted and compared.
        kinds = texts.select(F.explode(blocks).alias("b")).select(hash_of(F.col("b")).alias("h"), "b").join(clash, "h", "left_semi").distinct()
        smaller = kinds.alias("x").join(kinds.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("y.b") < F.col("x.b")), "left")
        ranks = smaller.groupBy("x.h", "x.b").agg(F.count("y.b").cast("int").alias("r"))
        found = texts.select("doc_id", F.sha2("raw", 256).alias("s"), hashes.alias("hs"), F.posexplode(blocks).alias("pos", "b"))
        found = found.select("doc_id", F.xxhash64("hs", "s").alias("text_key"), "pos", hash_of(F.col("b")).alias("h"), "b")
        rank_of = found.join(clash, "h", "left_semi").join(ranks, ["h", "b"]).select("doc_id", "text_key", "pos", "r").distinct()
        placed = occurrences.join(rank_of, ["doc_id", "text_key", "pos"], "left").withColumn("r", F.coalesce("r", F.lit(0)))
    placed = placed.select("doc_id", "text_key", "n_blocks", "pos", "h", "r")
    names = named(distinct.select("h", "n", F.explode(F.sequence(F.lit(0), (F.col("kinds") - 1).cast("int"))).alias("r")), ["h", "r"], "name")
    level = attach(placed, scratch.save(names, "names"), ["h", "r"], weight).select("doc_id", "text_key", "n_blocks", "pos", "name")
    level = scratch.save(level, "level")
    done = [level.where("n_blocks = 1").drop("pos")]
    rest, left = level.where("n_blocks > 1"), F.col("n_blocks")
    longest = marked.agg(F.max("n_blocks")).first()[0] or 1
    while longest > 1:
        pair = rest.groupBy("doc_id", "text_key", "n_blocks", (F.col("pos") / 2).cast("int").alias("half")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pair = scratch.save(pair.withColumnRenamed("half", "pos"), "pairs")
        groups = scratch.save(pair.groupBy("a", "b").agg(F.count("*").alias("n")), "groups")
        weight = weigh(groups)
        names = scratch.save(named(groups, ["a", "b"], "name"), "names")
        level = scratch.save(attach(pair, names, ["a", "b"], weight).select("doc_id", "text_key", "n_blocks", "pos", "name"), "level")
        left, longest = F.ceil(left / 2), -(-longest // 2)
        done.append(level.where(left == 1).drop("pos"))
        rest = level.where(left > 1)
    whole = reduce(DataFrame.unionByName, done)
    keys = ["doc_id", "text_key"]
    return whole.join(marked.select(*keys, "text_sha256", "copies"), keys)


def exact_dedup(docs: DataFrame, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES, hash_of=F.xxhash64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the largest doc_id is kept.
    """
    scratch = scratch or Scratch(docs.sparkSession, "exact")
    identity = block_identity(docs, scratch, block_bytes, hash_of)
    identity = scratch.save(identity, "identity")
    key = ["n_blocks", "name"]
    groups = scratch.save(identity.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"), F.sum("copies").alias("group_size")), "groups")
    out = attach(identity, groups, key, weigh(groups)).withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = {
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t
    """
}
QUERIES = {"op10_exact_dedup": op10_exact_dedup}
