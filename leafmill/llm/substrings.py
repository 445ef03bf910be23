"""Substring deduplication on a compacted de Bruijn graph of words (operator 2).

Edges are the windows of WINDOW consecutive words.  Every window is anchored
at its minimiser, the least of its K-word hashes, so equal windows have equal
anchors.  The windows that share an anchor occurrence are one path of the
graph, kept as one row (anchor, hash of the path's words, place).

Anchors that occur in a single document leave at once.  Of the others, an
anchor whose occurrences all spell one path doesn't branch: the path is
repeated as a whole and stays compact.  Where paths branch, one source per
distinct path is read again and its windows are joined one by one.  Either way
each window learns the smallest document that holds it, with the coordinates
there; windows that advance together with their source merge into long spans.
The words of every span are compared, by a 128-bit cryptographic digest, with
those at its source coordinates before anything is removed.

Cases: null texts have no words; texts under WINDOW words lose none; equal
texts lose all windows but those of the smallest doc_id; repeats inside one
document stay; every row is a document of its own: rows that share a doc_id
each lose only spans that verify on their own words and take nothing from one
another; very long texts are read whole, a run at a time; an empty table gives
an empty one; rows without doc_id are left out; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.exact_dedup import attach, weigh
from leafmill.llm.scratch import Scratch, only, restrict
from leafmill.llm.words import U64, Words, _table, grams, group_of, mix, runs, scan

WINDOW, K = 50, 16
_PATH, _EDGE = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
PATH = ["kmer", "span", "lo", "hi"]


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:])


def anchors(words: Words, window: int = WINDOW, k: int = K) -> dict[str, np.ndarray]:
    """The paths of some texts: text, pos (the anchor's word), lo and hi (windows start in pos-lo..pos+hi), kmer, span."""
    hashes = words.hashes()
    inside = group_of(words, window)
    start = np.flatnonzero(inside >= 0)
    if not len(start):
        return {c: np.zeros(0, np.int64) for c in ("text", "pos", "lo", "hi", "kmer", "span")}
    kmers = grams(hashes, k)
    place = U64(0xFFFFFFFF)
    # The leftmost of equal hashes: the place breaks ties, alike in equal windows.
    at = (least((kmers & ~place) | np.arange(len(kmers), dtype=U64), window - k + 1) & place).astype(np.int64)[start]
    text = inside[start]
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(start)] - 1
    s0, s1, pos, text = start[first], start[last], at[first], text[first]
    power, inverse = _table(len(hashes) + 1)
    sums = np.r_[U64(0), np.cumsum(mix(hashes + _PATH) * power[: len(hashes)])]
    span = mix((sums[s1 + window] - sums[s0]) * inverse[s0] + (s1 - s0).astype(U64))
    return {"text": text, "pos": pos - words.first[text], "lo": pos - s0, "hi": s1 - pos, "kmer": kmers[pos].view(np.int64), "span": span.view(np.int64)}


def joined(words: Words, keep: np.ndarray) -> Iterator[bytes]:
    """For each text its kept words, joined by one space."""
    at = np.flatnonzero(keep)
    owner = np.searchsorted(words.first, at, "right") - 1
    more = at[:-1][owner[1:] == owner[:-1]]  # kept words with a kept word behind them
    step = np.zeros(len(words.data) + 1, np.int8)
    step[words.start[at]] += 1
    step[words.end[at]] -= 1
    mask = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    data[words.end[more]], mask[words.end[more]] = 32, True
    packed = data[mask]
    kept = np.r_[0, np.cumsum(mask)]
    # A text's bytes end where its last kept word does.
    count = np.searchsorted(at, words.first)
    for lo, hi in zip(count[:-1].tolist(), count[1:].tolist(), strict=True):
        yield packed[kept[words.start[at[lo]]] : kept[words.end[at[hi - 1]]]].tobytes() if hi > lo else b""


def _paths(window: int, k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in runs(batch["text"]):
                found = anchors(scan(data, offsets), window, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["kmer"]), pa.array(found["span"]), pa.array(ids[lo:hi][found["text"]]), *[pa.array(found[c].astype(np.int32)) for c in ("pos", "lo", "hi")]],
                    ["kmer", "span", "doc_id", "pos", "lo", "hi"],
                )

    return work


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_words, sha of all words) of each row."""
    for batch in batches:
        sizes, digests = [], []
        for _, _, data, offsets in runs(batch["text"]):
            words = scan(data, offsets)
            sizes.append(words.counts())
            digests += [hashlib.sha256(x).hexdigest() for x in joined(words, np.ones(len(words.start), bool))]
        size = np.concatenate(sizes) if sizes else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(size.astype(np.int64)), pa.array(digests, pa.string())], ["doc_id", "n_words", "sha"])


def _fields(column: pa.Array, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets of a list column of structs, and its structs' fields."""
    flat = column.flatten()
    size = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy())])
    return size, *[flat.field(n).to_numpy(zero_copy_only=False) for n in names]


def _edges(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, pos, lo, hi = _fields(batch["reps"], "pos", "lo", "hi")
            flat = batch["reps"].flatten()
            for a, b, data, offsets in runs(batch["text"]):
                words = scan(data, offsets)
                edge = grams(mix(words.hashes() + _EDGE), window).view(np.int64)
                own = np.arange(bounds[a], bounds[b])
                text = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                size = lo[own] + hi[own] + 1
                j = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) - np.repeat(lo[own], size)
                at = np.repeat(words.first[text] + pos[own], size) + j
                fits = (at >= 0) & (at < len(edge))
                which, j, at = np.repeat(own, size)[fits], j[fits], at[fits]
                some = flat.take(pa.array(which))
                doc = batch["doc_id"].take(pa.array(np.repeat(text, size)[fits] + a))
                yield pa.RecordBatch.from_arrays([*[some.field(c) for c in (*PATH, "last", "pos")], doc, pa.array(j.astype(np.int32)), pa.array(edge[at])], [*PATH, "last", "pos", "doc_id", "j", "w"])

    return work


def _chain(window: int):
    """Merge runs of windows that advance together with their source into spans of words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, start, count, src, src_start = _fields(batch["runs"], "start", "count", "src", "src_start")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            order = np.lexsort((start, start - src_start, src, owner))
            owner, start, count, src, src_start = (x[order] for x in (owner, start, count, src, src_start))
            new = np.r_[True, (owner[1:] != owner[:-1]) | (src[1:] != src[:-1]) | (src_start[1:] - start[1:] != src_start[:-1] - start[:-1]) | (start[1:] > start[:-1] + count[:-1])][: len(start)]
            first = np.flatnonzero(new)
            end = np.maximum.reduceat(start + count, first) if len(first) else start
            size = end - start[first] + window - 1
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(owner[first])), *[pa.array(x.astype(np.int64)) for x in (start[first], size, src[first], src_start[first])]], ["doc_id", "start", "size", "src", "src_start"])

    return work


def _digest(words: Words, t: int, start: int, size: int) -> bytes | None:
    lo = int(words.first[t]) + start
    if start < 0 or lo + size > words.first[t + 1]:
        return None
    part = Words(words.data[words.start[lo] : words.end[lo + size - 1]], words.start[lo : lo + size] - words.start[lo], words.end[lo : lo + size] - words.start[lo], np.array([0, size]))
    return hashlib.blake2b(next(joined(part, np.ones(size, bool))), digest_size=16).digest()


def _sources(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, start, size = _fields(batch["asked"], "src_start", "size")
        rows: list[tuple] = []
        for a, b, data, offsets in runs(batch["text"]):
            words = scan(data, offsets)
            for t in range(a, b):
                doc = batch["doc_id"][t].as_py()
                for i in range(bounds[t], bounds[t + 1]):
                    if digest := _digest(words, t - a, int(start[i]), int(size[i])):
                        rows.append((doc, int(start[i]), int(size[i]), digest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["src", "src_start", "size", "digest"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, start, size, digest = _fields(batch["spans"], "start", "size", "digest")
        lost, shas, own = [], [], []
        for a, b, data, offsets in runs(batch["text"]):
            words = scan(data, offsets)
            keep = np.ones(len(words.start), bool)
            for t in range(a, b):
                for i in range(bounds[t], bounds[t + 1]):
                    if _digest(words, t - a, int(start[i]), int(size[i])) == digest[i]:
                        lo = words.first[t - a] + start[i]
                        keep[lo : lo + size[i]] = False
            lost += (words.counts() - np.diff(np.r_[0, np.cumsum(keep)][words.first])).tolist()
            shas += [hashlib.sha256(x).hexdigest() for x in joined(words, keep)]
            own += [hashlib.sha256(x).hexdigest() for x in joined(words, np.ones(len(keep), bool))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(own, pa.string()), pa.array(lost, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "sha", "n_removed", "kept"])


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Spans (doc_id, start, size, src, src_start, digest), in words, and the texts of the documents in question."""
    texts = only(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    paths = scratch.save(texts.mapInArrow(_paths(window, k), "kmer bigint, span bigint, doc_id bigint, pos int, lo int, hi int"), "paths")
    shared = paths.groupBy("kmer").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").select("kmer", "n")
    shared = scratch.save(shared, "shared")
    rows = scratch.save(attach(paths, shared, ["kmer"], weigh(shared)), "repeated")
    scratch.drop(paths)
    involved = scratch.save(rows.select("doc_id").distinct(), "involved")
    own = scratch.save(restrict(texts, involved, involved.count(), "doc_id"), "texts")

    distinct = rows.groupBy(*PATH).agg(F.min(F.struct("doc_id", "pos")).alias("src"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    distinct = scratch.save(distinct, "distinct")
    ways = scratch.save(distinct.groupBy("kmer").agg(F.count("*").alias("n")), "ways")
    routed = attach(distinct.withColumnRenamed("n", "uses"), ways.withColumn("ways", F.col("n")), ["kmer"], weigh(ways))
    routed = scratch.save(routed, "routed")
    run = lambda a, b: F.struct(a.alias("a"), b.alias("b"), F.col("src.doc_id").alias("src"), F.col("src.pos").alias("at"))
    plain = routed.where("ways = 1 AND src.doc_id < last").select(*PATH, F.col("uses").alias("n"), F.array(run(-F.col("lo"), F.col("hi"))).alias("runs"))

    forks = routed.where("ways > 1")
    reps = forks.groupBy(F.col("src.doc_id").alias("doc_id")).agg(F.collect_list(F.struct(*PATH, "last", F.col("src.pos").alias("pos"))).alias("reps"))
    edges = own.join(reps, "doc_id").mapInArrow(_edges(window), "kmer bigint, span bigint, lo int, hi int, last bigint, pos int, doc_id bigint, j int, w bigint")
    edges = scratch.save(edges, "edges")
    met = edges.groupBy("kmer", "j", "w").agg(F.min(F.struct("doc_id", "pos")).alias("src"), F.max("last").alias("latest"), F.count("*").alias("n")).where("src.doc_id < latest").drop("latest")
    met = scratch.save(met, "met")
    hits = attach(edges.select(*PATH, "j", "w"), met, ["kmer", "j", "w"], weigh(met)).select(*PATH, "j", "src")
    island = F.col("j") - F.row_number().over(Window.partitionBy(*PATH, "src").orderBy("j"))
    merged = hits.withColumn("island", island).groupBy(*PATH, "src", "island").agg(F.min("j").alias("a"), F.max("j").alias("b"))
    merged = merged.groupBy(*PATH).agg(F.collect_list(run(F.col("a"), F.col("b"))).alias("runs"))
    forked = merged.join(forks.select(*PATH, F.col("uses").alias("n")), PATH).select(*PATH, "n", "runs")

    answers = scratch.save(plain.unionByName(forked), "answers")
    found = attach(rows.select(*PATH, "doc_id", "pos"), answers, PATH, weigh(answers)).select("doc_id", "pos", F.explode("runs").alias("r")).where("r.src < doc_id")
    each = F.struct((F.col("pos") + F.col("r.a")).alias("start"), (F.col("r.b") - F.col("r.a") + 1).alias("count"), F.col("r.src").alias("src"), (F.col("r.at") + F.col("r.a")).alias("src_start"))
    spans = found.groupBy("doc_id").agg(F.collect_list(each).alias("runs")).mapInArrow(_chain(window), "doc_id bigint, start bigint, size bigint, src bigint, src_start bigint")
    spans = scratch.save(spans, "spans")
    scratch.drop(edges, rows)

    key = ["src", "src_start", "size"]
    wanted = scratch.save(spans.groupBy(*key).agg(F.count("*").alias("n")), "wanted")
    asked = wanted.groupBy(F.col("src").alias("doc_id")).agg(F.collect_list(F.struct("src_start", "size")).alias("asked"))
    digests = own.join(asked, "doc_id").mapInArrow(_sources, "src bigint, src_start bigint, size bigint, digest binary").distinct()
    proved = scratch.save(digests.join(wanted, key), "digests")
    return scratch.save(attach(spans, proved, key, weigh(proved)), "verified"), own


def substring_dedup(docs: DataFrame, scratch: Scratch | None = None, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    scratch = scratch or Scratch(docs.sparkSession, "substrings")
    spans, own = repeated_spans(docs, scratch, window, k)
    per = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "digest")).alias("spans"))
    cut = scratch.save(own.join(per, "doc_id").mapInArrow(_removed, "doc_id bigint, sha string, n_removed bigint, kept string").distinct(), "cut")
    whole = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(_whole, "doc_id bigint, n_words bigint, sha string")
    # Texts may share a doc_id: the digest of a text's words tells whose result it is.
    return whole.join(cut, ["doc_id", "sha"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_SPLIT = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')"
ORACLE = {
    "op2_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50),
        x AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS h FROM p),
        m AS (SELECT h, min(doc_id) AS first_doc FROM x GROUP BY h HAVING count(DISTINCT doc_id) > 1),
        r AS (SELECT x.doc_id, x.s FROM x JOIN m USING (h) WHERE m.first_doc < x.doc_id),
        c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM r),
        e AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        k AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(e.word, ' ' ORDER BY e.i) AS t FROM e ANTI JOIN c USING (doc_id, i) GROUP BY 1)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """
}
QUERIES = {"op2_substring_dedup": op2_substring_dedup}
