"""Near-duplicates by bottom-k sketches of one hash function (operator 9).

A document's set is that of its 5-word shingles (A-Z lower-cased); its sketch
holds the 64 smallest hashes.  Equal sets become one class by a 128-bit digest
of the whole set.  Inverted lists of retained values generate candidates: two
sets of Jaccard 0.7 share at least NEEDED retained values but for a chance
under 1e-6, so by the prefix principle they share one among the rarest
``len - NEEDED + 1`` values of each; only these are listed, which keeps
passages that thousands of documents share out of the lists.

Lists give stars: each member is paired with the list's first member, its hub,
which then leaves the list, as it has met all others.  Pairs are checked by the
estimate from the union's sketch, then by exact Jaccard on full sets; verified
links join classes, and only lists that hold several components go on.  Lists
that are still open after STAR_ROUNDS mostly hold sets that share a core
without being alike; sketches can't part them, so their members are listed anew
by their full sets, with prefixes as short as the sizes of both partners allow:
a core too small for the similarity is then in no list.  These lists give stars
too, of as many hubs as keep a round at HUBS pairs for each entry of the first
lists: work is linear in the input, whatever the lists' lengths.  No link is
lost, as rounds go on until every list is used up.

Cases: null, empty or blank text: an empty set, linked with nothing; fewer
than five words: the whole sequence is the one shingle; an empty table gives an
empty one; rows without doc_id are left out; every row is a document of its
own: rows that share a doc_id are linked by their sets alone, and each has the
component of its own text; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.exact_dedup import attach, weigh
from leafmill.llm.graph import components
from leafmill.llm.scratch import BROADCAST_ROWS, Scratch, only, restrict
from leafmill.llm.words import grams, group_of, runs, scan

SHINGLE, SKETCH, NEEDED, PERCENT = 5, 64, 26, 70
#: Least estimate from a union sketch at which a pair is verified: 0.7 less over five standard errors.
ESTIMATE = 0.40
STAR_ROUNDS, HUBS = 1, 16
#: Documents and shingles (8 bytes each) that a task holds while it verifies pairs.
BUCKET_DOCS, BUCKET_SHINGLES = 1500, 4_000_000
ENTRY = ["v", "node", "size", "side"]
#: Ratio of the sizes in one bucket when full sets are listed.
STEP = 1.04


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    for _, _, data, offsets in runs(column):
        words = scan(data, offsets, lower=True)
        hashes = words.hashes()
        shingles, owner = grams(hashes, SHINGLE), group_of(words, SHINGLE)
        for t, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
            if hi - lo >= SHINGLE:
                found = np.sort(shingles[lo : hi - SHINGLE + 1])
                assert owner[lo] == t
                yield found[np.r_[True, found[1:] != found[:-1]]]
            else:
                yield grams(hashes[lo:hi], hi - lo) if hi > lo else hashes[:0]


def sketches(docs: DataFrame, k: int = SKETCH) -> DataFrame:
    """(row, doc_id, text_hash, n_shingles, set_key, sketch) of each row; row is a number that stays once this is saved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, kept = [], [], []
            for found in shingle_sets(batch["text"]):
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                kept.append(found[:k].view(np.int64).copy())  # a view would hold the whole set
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_hash"], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["doc_id", "text_hash", "n_shingles", "set_key", "sketch"])

    found = _texts(docs).mapInArrow(work, "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, sketch array<bigint>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").where("doc_id IS NOT NULL").withColumn("text_hash", F.xxhash64("text"))


def inverted_lists(classes: DataFrame, scratch: Scratch, k: int, needed: int, percent: int) -> DataFrame:
    """(v, node, size, side) of the rare retained values that at least two classes list; side: null."""
    rows = classes.select("node", "size", F.explode("sketch").alias("v"))
    shared = scratch.save(rows.groupBy("v").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    counted = attach(rows, shared.withColumn("df", F.col("n")), ["v"], weigh(shared))
    length = F.least(F.col("size"), F.lit(k))
    exact = F.ceil(F.col("size") * percent / 100)
    least = F.when(F.col("size") * 100 <= percent * k, exact).otherwise(F.least(exact, F.lit(needed)))
    per = counted.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("own"))
    room = (length - least + 1) - (length - F.size("own"))  # values that only this class has come first
    rare = per.withColumn("room", F.greatest(F.lit(0), room).cast("int")).where("room > 0")
    listed = rare.select("node", "size", F.explode(F.slice("own", 1, F.col("room"))).alias("o"))
    return _met(listed.select(F.col("o.v").alias("v"), "node", "size", F.lit(None).cast("int").alias("side")), scratch)


def _met(listed: DataFrame, scratch: Scratch) -> DataFrame:
    """Lists without those of one member or, where they have two sides, of one side."""
    listed = scratch.save(listed, "listed")
    again = listed.groupBy("v").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi")).where("n > 1 AND (lo IS NULL OR lo < hi)")
    again = scratch.save(again.select("v", "n"), "again")
    return scratch.save(attach(listed, again, ["v"], weigh(again)).select(*ENTRY), "lists")


def exact_lists(texts: DataFrame, scratch: Scratch, percent: int, step: float = STEP) -> DataFrame:
    """(v, node, size, side) by full sets (node, text): v names a shingle and the size buckets of two partners.

    Sets of sizes x and y with the similarity share ``need`` shingles, so they
    share one among the rarest x - need + 1 of one and y - need + 1 of the other.
    Where the buckets differ, a list has the smaller sets on side 0 and the
    larger ones on side 1, and only sets of different sides are partners.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, found in enumerate(shingle_sets(batch["text"])):
                node = batch["node"].take(pa.array(np.full(len(found), i)))
                yield pa.RecordBatch.from_arrays([node, pa.array(np.full(len(found), len(found), np.int64)), pa.array(found.view(np.int64))], ["node", "size", "s"])

    rows = scratch.save(texts.select("node", "text").mapInArrow(work, "node bigint, size bigint, s bigint"), "shingles")
    shared = scratch.save(rows.groupBy("s").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    per = attach(rows, shared.withColumn("df", F.col("n")), ["s"], weigh(shared)).groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("own"))
    size = F.col("size")
    bucket = lambda n: F.floor(F.log(n.cast("double")) / float(np.log(step))).cast("int")
    lowest, highest = F.ceil(size * percent / 100), F.floor(size * 100 / percent)

    def values(b):
        # The least size in the bucket, safe from rounding.
        partner = F.greatest(lowest, F.ceil(F.pow(F.lit(step), b) * (1 - 1e-9)))
        need = F.ceil((size + partner) * percent / (100 + percent))
        room = F.greatest(F.lit(0), (F.size("own") - need + 1).cast("int"))
        own = bucket(size)
        side = F.when(b > own, 0).when(b < own, 1)
        return F.transform(F.slice("own", F.lit(1), room), lambda o: F.struct(F.xxhash64(o["s"], F.least(b, own), F.greatest(b, own)).alias("v"), side.alias("side")))

    every = F.flatten(F.transform(F.sequence(bucket(lowest), bucket(highest)), values))
    return _met(per.select(F.explode(every).alias("e"), "node", "size").select("e.v", "node", "size", "e.side"), scratch)


def open_lists(lists: DataFrame, labels: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """Entries with part, n, small of lists in several components; the rows that all have and the most of one.

    n: members; small: the side of fewer members in a list of two sides.
    """
    if labels is None:
        here = lists.withColumn("part", F.col("node"))
    else:
        here = lists.join(labels, "node", "left").select(*ENTRY, F.coalesce("component", "node").alias("part"))
    count = lambda side: F.coalesce(F.sum((F.col("side") == side).cast("int")), F.lit(0)).alias(f"n{side}")
    heads = here.groupBy("v").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"), count(0), count(1))
    heads = heads.where("lo <> hi AND (n0 + n1 = 0 OR n0 > 0 AND n1 > 0)")
    heads = scratch.save(heads.select("v", "n", F.col("n").alias("members"), F.expr("IF(n0 + n1 = 0, NULL, IF(n0 <= n1, 0, 1))").alias("small")), "heads")
    total, most = weigh(heads)
    if not total:
        return lists, 0, 0
    return scratch.save(attach(here, heads, ["v"], (total, most)).withColumnRenamed("members", "n"), "open"), total, most


def stars(here: DataFrame, weight: tuple[int, int], hubs: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, w) of the first ``hubs`` members of each list with all others; and the lists without these members.

    In a list of two sides hubs are of the smaller side and their partners of
    the other; it ends with its smaller side.  w: shingles of both.  What is in
    one component already or differs too much in size isn't paired.
    """
    central = F.col("small").isNull() | (F.col("side") == F.col("small"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("node"))
    first = here.where(central).withColumn("rank", rank).where(F.col("rank") <= hubs)
    first = scratch.save(first.select("v", "n", "rank", F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("part").alias("hub_part")), "hubs")
    met = attach(here.drop("n"), first.drop("rank"), ["v"], weight)
    fits = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    others = F.when(F.col("small").isNull(), F.col("node") > F.col("hub")).otherwise(F.col("side") != F.col("small"))
    pairs = met.where(others & (F.col("part") != F.col("hub_part")) & fits)
    pairs = pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), (F.col("size") + F.col("hub_size")).alias("w")).distinct()
    if weight[1] <= hubs + 1:
        return pairs, None
    last = first.where((F.col("rank") == hubs) & (F.col("n") > hubs + 1)).select("v", "n", F.col("hub").alias("last"))
    rest = attach(here.drop("n"), last, ["v"], weight).where(~central | (F.col("node") > F.col("last")))
    return pairs, scratch.save(rest.select(*ENTRY), "lists")


def verified(pairs: DataFrame, n_pairs: int, texts: DataFrame, scratch: Scratch, k: int, estimate: float, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets have the Jaccard similarity, by estimate and then exactly.

    Pairs (a, b, w) of one candidate component meet in one bucket, so that each
    text travels once; components of many documents or shingles are split by a.
    """
    if not n_pairs:
        return pairs
    part = components(pairs, scratch, at_most=n_pairs)
    sized = pairs.join(part.withColumnRenamed("node", "a"), "a")
    weight = scratch.save(sized.groupBy("component").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "weights")
    many = weight.withColumn("cuts", F.greatest(F.ceil(F.col("n") / (2 * BUCKET_DOCS)), F.ceil(F.col("w") / BUCKET_SHINGLES))).drop("w")
    buckets = max(1, 2 * n_pairs // BUCKET_DOCS, (weight.agg(F.sum("w")).first()[0] or 0) // BUCKET_SHINGLES)
    place = F.pmod(F.xxhash64("component", F.pmod(F.xxhash64("a"), "cuts")), F.lit(buckets)).cast("int")
    placed = scratch.save(attach(sized, many, ["component"], weigh(weight)).select("a", "b", place.alias("bucket")), "placed")
    wanted = placed.select("bucket", F.col("a").alias("node")).unionByName(placed.select("bucket", F.col("b").alias("node"))).distinct()
    wanted = scratch.save(wanted, "wanted")
    small = 2 * n_pairs <= BROADCAST_ROWS or wanted.count() <= BROADCAST_ROWS
    sent = texts.join(F.broadcast(wanted) if small else wanted, "node").select("bucket", "node", "text")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = right["node"].to_pylist()
        found = dict(zip(docs, (s for chunk in right["text"].chunks for s in shingle_sets(chunk)), strict=True))
        a, b = left["a"].to_pylist(), left["b"].to_pylist()
        keep = [similar(found[x], found[y], k, estimate, percent) for x, y in zip(a, b, strict=True)]
        return left.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return scratch.save(placed.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(compare, "a bigint, b bigint"), "verified")


def common(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(y) else 0


def similar(x: np.ndarray, y: np.ndarray, k: int, estimate: float, percent: int) -> bool:
    if not len(x) or not len(y) or 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    union = np.union1d(x[:k], y[:k])[:k]
    top = union[-1]
    both = common(x[: np.searchsorted(x, top, "right")], y[: np.searchsorted(y, top, "right")])
    if both < estimate * len(union):
        return False
    shared = common(x, y)
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def near_rows(
    docs: DataFrame, scratch: Scratch, k: int = SKETCH, needed: int = NEEDED, percent: int = PERCENT, estimate: float = ESTIMATE, star_rounds: int = STAR_ROUNDS, counts: list[int] | None = None
) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component) of each row of docs; component names what hangs together.

    counts, if given, gets the number of pairs compared in each round.
    """
    all_rows = scratch.save(sketches(docs, k), "sketches")
    # A class is named by one of its rows.
    sets = scratch.save(all_rows.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc"), F.count("*").alias("n")), "sets")
    n_sets = sets.count()
    named = all_rows.where("set_key IS NOT NULL").withColumnRenamed("row", "node")
    classes = restrict(named, sets.select("node"), n_sets, "node").select("node", F.col("n_shingles").alias("size"), "sketch")
    lists = inverted_lists(classes, scratch, k, needed, percent)
    members = scratch.save(lists.select("node").distinct(), "members")
    n_members = members.count()
    where = restrict(named.select("node", "doc_id", "text_hash"), members, n_members, "node")
    texts = _texts(docs).join(F.broadcast(where) if n_members <= BROADCAST_ROWS else where, ["doc_id", "text_hash"]).select("node", "text")
    texts = scratch.save(texts, "texts")

    links: DataFrame | None = None
    labels: DataFrame | None = None
    tried: DataFrame | None = None
    n_tried = step = budget = 0
    while True:
        here, total, most = open_lists(lists, labels, scratch)
        if total and step == star_rounds:
            core = scratch.save(here.select("node").distinct(), "core")
            here, total, most = open_lists(exact_lists(restrict(texts, core, core.count(), "node"), scratch, percent), labels, scratch)
        if not total:
            break
        budget = max(budget, HUBS * total)
        pairs, rest = stars(here, (total, most), 1 if step < star_rounds else budget // total, percent, scratch)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.save(pairs, "candidates")
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        n_pairs = pairs.count()
        n_tried += n_pairs
        if counts is not None:
            counts.append(n_pairs)
        found = verified(pairs, n_pairs, texts, scratch, k, estimate, percent).select("a", "b")
        links = found if links is None else links.unionByName(found)
        labels = components(links, scratch, at_most=n_tried)
        step += 1
        if rest is None:
            break
        lists = rest
    classed = sets.select("set_key", "n", F.col("node").alias("component"), F.col("doc").alias("component_id"))
    if labels is not None:
        linked = labels.join(sets.select("node", "doc"), "node")
        least = scratch.save(linked.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("n")), "least")
        own = attach(labels, least, ["component"], weigh(least))
        classed = sets.join(own, "node", "left").select("set_key", "n", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "doc").alias("component_id"))
    scratch.drop(texts)
    slim = all_rows.select("row", "doc_id", "text_hash", "n_shingles", "set_key")
    with_set = attach(slim.where("set_key IS NOT NULL").drop("row"), scratch.save(classed, "classes"), ["set_key"], weigh(sets))
    alone = slim.where("set_key IS NULL").withColumns({"component": F.col("row"), "component_id": F.col("doc_id")})
    columns = ["doc_id", "text_hash", "n_shingles", "component_id", "component"]
    return with_set.select(*columns).unionByName(alone.select(*columns))


def near_dedup(docs: DataFrame, scratch: Scratch | None = None, **how) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    rows = near_rows(docs, scratch or Scratch(docs.sparkSession, "near"), **how)
    return rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op9_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
