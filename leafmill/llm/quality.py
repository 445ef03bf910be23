"""Quality classifier on random-indexing word vectors (operator 8).

Each word has a sparse ternary index vector drawn from its hash.  Over all
documents a word's vector sums the index vectors of its neighbours; words share
BUCKETS rows of a table of fixed size, of which each task makes one and tasks
add up sixteen.  A document pools (averages) the vectors of its words and, in
the same way, of its word forms (letters by case, digits, punctuation, whether
the word repeats the one before).  A two-layer network in numpy turns pooled
vectors into a probability, whose temperature is fitted on rows that the
network was not trained on.

Labels are learnt only from rows whose crc32(doc_id) mod 5 is not 0 and at
most SAMPLE of those, chosen by a hash of doc_id.  Whole texts of all
documents are scored; labels, lang, source and doc_id never enter a score.

Cases: null and empty texts pool to zeros and get a score as any other; rows
without label aren't learnt from; a doc_id with clashing labels counts as 1;
with no labels at all, or labels of one kind, the score is that kind's share
(0.5 without labels); an empty table gives an empty one; very long texts are
read whole, a run at a time; rows that repeat are each scored; rows without
doc_id are left out; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch, only, read_file, write_file
from leafmill.llm.words import U64, Words, mix, runs, scan

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 8000
BUCKETS, WIDTH, NONZERO, WINDOW = 1 << 15, 64, 4, 2
HIDDEN, EPOCHS, THRESHOLD, FOLDS = 32, 60, 0.3, 5
#: UTF-8 bytes of text that are pooled at once.
RUN_BYTES = 1 << 19
#: Word vectors that are summed at once.
GATHER = 1 << 13

_FORM = np.arange(256, dtype=np.uint8)
_FORM[97:123], _FORM[128:], _FORM[65:91], _FORM[48:58] = 97, 97, 65, 48


def draws(buckets: int, width: int, nonzero: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places of its index vector's entries, and their signs; both (nonzero, buckets)."""
    draw = np.stack([mix(np.arange(buckets, dtype=U64) * U64(nonzero) + U64(j + (seed << 32))) for j in range(nonzero)])
    return ((draw >> U64(1)) % U64(width)).astype(np.int64), np.where(draw & U64(1), 1, -1).astype(np.int32)


def index_vectors(buckets: int, width: int, nonzero: int, seed: int) -> np.ndarray:
    """int8 (buckets, width): the index vectors; where places coincide the last sign counts."""
    out, (places, signs) = np.zeros((buckets, width), np.int8), draws(buckets, width, nonzero, seed)
    for place, sign in zip(places, signs, strict=True):
        out[np.arange(buckets), place] = sign
    return out


def form_hashes(words: Words, hashes: np.ndarray) -> np.ndarray:
    """Hash of each word's form: byte classes with runs collapsed, and whether it repeats the word before."""
    kind = _FORM[words.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    forms = Words(kind[keep], at[words.start], at[words.end], words.first).hashes(1)
    same = np.zeros(len(hashes), U64)
    same[1:] = hashes[1:] == hashes[:-1]
    same[words.first[:-1][words.counts() > 0]] = 0
    return mix(forms + same)


def streams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: bounds of texts, buckets of words, buckets of forms."""
    for _, _, data, offsets in runs(column, RUN_BYTES):
        words = scan(data, offsets)
        hashes = words.hashes()
        yield words.first, (hashes % U64(BUCKETS)).astype(np.int64), (form_hashes(words, hashes) % U64(BUCKETS)).astype(np.int64)


def neighbours(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    """int64 (2, BUCKETS, WIDTH): sums of the neighbours' index vectors, of words and of forms."""
    total = np.zeros((2, BUCKETS * WIDTH), np.int64)
    # Of coinciding places one entry stays, so that sums agree with index_vectors.
    entries = []
    for seed in (1, 2):
        rows, places = np.nonzero(index_vectors(BUCKETS, WIDTH, NONZERO, seed))
        count = np.bincount(rows, minlength=BUCKETS)
        entries.append((np.cumsum(count) - count, count, places, index_vectors(BUCKETS, WIDTH, NONZERO, seed)[rows, places].astype(np.int64)))
    for batch in batches:
        for first, *kinds in streams(batch["text"]):
            owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
            for table, (begin, size, places, signs), ids in zip(total, entries, kinds, strict=True):
                for step in range(1, WINDOW + 1):
                    near = owner[step:] == owner[:-step]
                    left, right = ids[:-step][near], ids[step:][near]
                    pair, count = np.unique(np.concatenate([left * BUCKETS + right, right * BUCKETS + left]), return_counts=True)
                    to, of = pair // BUCKETS, pair % BUCKETS
                    for j in range(NONZERO):
                        some = size[of] > j
                        at = begin[of[some]] + j
                        np.add.at(table, to[some] * WIDTH + places[at], signs[at] * count[some])
    return total.reshape(2, BUCKETS, WIDTH)


def word_vectors(total: np.ndarray) -> np.ndarray:
    """float32 vectors: normalised sums plus the word's own index vector."""
    out = total.astype(np.float32)
    for table, seed in zip(out, (1, 2), strict=True):
        table /= np.maximum(np.sqrt(np.einsum("bw,bw->b", table, table)), 1)[:, None]
        table += index_vectors(BUCKETS, WIDTH, NONZERO, seed) * np.float32(0.5)
    return out


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """float32 (texts, 2 * WIDTH): mean vectors of words and of forms."""
    parts = [np.zeros((0, 2 * WIDTH), np.float32)]
    ones = np.ones(GATHER, np.float32)
    for first, *kinds in streams(column):
        out = np.zeros((len(first) - 1, 2, WIDTH), np.float32)
        bounds = first.tolist()
        for t, (lo, hi) in enumerate(zip(bounds, bounds[1:], strict=False)):
            for j, (table, ids) in enumerate(zip(vectors, kinds, strict=True)):
                for at in range(lo, hi, GATHER):
                    some = ids[at : min(at + GATHER, hi)]
                    out[t, j] += ones[: len(some)] @ table[some]
        count = np.diff(first)
        out[count > 0] /= count[count > 0, None, None]
        parts.append(out.reshape(len(out), 2 * WIDTH))
    return np.concatenate(parts)


@dataclass
class Network:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -500, 500)))


def train(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss over three quarters of the rows; the rest calibrate."""
    x, y, draw = x.astype(np.float64), y.astype(np.float64), np.random.default_rng(seed)
    width = x.shape[1]
    if len(y) == 0 or y.min() == y.max():
        share = min(max(y.mean() if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Network(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))), 1.0)
    order = draw.permutation(len(y))
    held = order[: len(y) // 4]
    own = order[len(y) // 4 :] if len(y) >= 8 else order
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = (x - mean) / scale
    p = [draw.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for part in np.array_split(draw.permutation(own), max(1, len(own) // 128)):
            h = np.tanh(z[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -50, 50))) - y[part]) / len(part)
            dh = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for i, g in enumerate((z[part].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum(keepdims=True))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(vectors, mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    if len(held):
        logits = net.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / t).mean() for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fold(doc_id, n: int):
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def neighbour_sums(texts: DataFrame, scratch: Scratch, fan_in: int = 16) -> np.ndarray:
    """``neighbours`` of all texts: a table of fixed size from each task, added up ``fan_in`` at a time by further tasks."""

    def packed(table: np.ndarray) -> bytes:
        # The least type that holds the numbers, told by the length.
        top = np.abs(table).max(initial=0)
        return table.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64).tobytes()

    def read(blob) -> np.ndarray:
        return np.frombuffer(blob, {1: np.int16, 2: np.int32, 4: np.int64}[len(blob) // (4 * BUCKETS * WIDTH)])

    def row(blob: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], ["blob"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is not None:
            yield row(packed(neighbours(itertools.chain([first], batches))))

    def total_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for blob in batch["blob"]:
                part = read(blob.as_buffer())
                total = part.astype(np.int64) if total is None else np.add(total, part, out=total)
        return total

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (total := total_of(batches)) is not None:
            yield row(packed(total))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The driver's Python reads the sums from the shared folder; its JVM never holds them.
        if (total := total_of(batches)) is not None:
            write_file(at, packed(total))
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], ["n"])

    at = scratch.path("sums.bin")
    parts = scratch.save(texts.mapInArrow(sums, "blob binary"), "sums")
    while (n := parts.count()) > fan_in:
        more = scratch.save(parts.repartition(-(-n // fan_in)).mapInArrow(add, "blob binary"), "sums")
        scratch.drop(parts)
        parts = more
    if not scratch.save(parts.repartition(1).mapInArrow(store, "n bigint"), "stored").count():
        return np.zeros((2, BUCKETS, WIDTH), np.int64)
    scratch.drop(parts)
    return read(read_file(at).view(np.uint8)).reshape(2, BUCKETS, WIDTH)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", sample: int = SAMPLE) -> Network:
    known = labels.select("doc_id", F.col(f"`{label}`").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("doc_id"), FOLDS) != 0))
    chosen = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = scratch.save(only(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")

    total = neighbour_sums(only(docs, "text").where("text IS NOT NULL"), scratch)
    vectors = word_vectors(total)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 16 MB at any size of input

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x.tobytes() for x in pooled(batch["text"], shared.value)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"].cast(pa.int32()), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    found = texts.mapInArrow(pool, "doc_id bigint, y int, x binary").orderBy("doc_id", "x").toPandas()
    scratch.drop(texts)
    x = np.stack([np.frombuffer(b, np.float32) for b in found["x"]]) if len(found) else np.zeros((0, 2 * WIDTH))
    return train(vectors, x, found["y"].to_numpy())


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net = model.value
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(net.score(pooled(batch["text"], net.vectors)))], ["doc_id", "score"])

    scored = only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(work, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, scratch: Scratch | None = None, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, labels, scratch or Scratch(docs.sparkSession, "quality"), sample=sample))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}


def keep_good(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least the threshold; in one pass, without a join."""
    model = docs.sparkSession.sparkContext.broadcast(net)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net = model.value
            yield batch.filter(pa.array(net.score(pooled(batch["text"], net.vectors)) >= threshold))

    return docs.mapInArrow(work, docs.schema)
