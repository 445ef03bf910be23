"""Language-model scores from a log-frequency Bloom filter (operator 5).

Word counts are exact, in sorted arrays.  Bigram counts are quantised: a count
c enters the filter as 1 + floor(log(c, BASE)) entries (bigram, 1), (bigram, 2)
and so on, and reading it back probes 1, 2, ... until one is missing.  The
filter is blocked, one 64-bit word an entry; errors only ever raise a count, in
about three of a thousand cases, and counts are held under those of both words.
The probability of a word interpolates the bigram's share of its context with
the add-one unigram, of which the base score is made:

    p(w | h) = MIX * q(h, w) / c(h) + (1 - MIX) * (c(w) + 1) / (N + V + 1)

Quantising rounds counts down, so for a known h these sum to a little under 1
over all words and the unknown one: the probability is deficient, never more
than a whole one but for the filter's errors.

Everything is counted over all training documents: map tasks combine, counts
are routed by hash into segments, sorted by the JVM, and each segment is built
by itself and written to the shared folder; a segment without tokens is an
empty file there, so that a lost one is an error and not a zero.  Sorted keys
of one segment travel as one row, as differences in few bytes.  While the
model takes at most MODEL_BYTES it is put together and memory-mapped by every
worker.  Beyond that documents are packed into chunks of CHUNK_BYTES, of which
each asks every segment once for its distinct words and bigrams; counts come
back in the order asked, a byte for a bigram, to one file a chunk, and the
chunk is scored against that file.  Both ways give the same numbers.

Cases: null and empty texts are one end token; with no training documents all
words are unknown and N = V = 0; an empty table gives an empty one; very long
texts are read whole, a run at a time; rows that share a doc_id and repeated
rows are each counted and scored; rows without doc_id are left out; columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.quality import fold
from leafmill.llm.scratch import Scratch, only, read_file, write_file, write_parts
from leafmill.llm.words import U64, mix, runs, scan

FOLDS, HELD, MIX, BASE, BITS, PROBES = 7, 2, 0.4, 1.5, 16, 5
MODEL_BYTES, SEGMENT_BYTES, CHUNK_BYTES = 1 << 30, 1 << 22, 1 << 24
END = U64(0x0E0D0E0D0E0D0E0D)
_LEFT, _RIGHT, _STEP = U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9), U64(0x27D4EB2F165667C5)


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: first text, bounds, tokens with an end after each text, and the tokens before them."""
    for lo, _, data, offsets in runs(column):
        words = scan(data, offsets, lower=True)
        n = len(words.first) - 1
        found = np.full(len(words.start) + n, END)
        owner = np.repeat(np.arange(n), words.counts())
        found[np.arange(len(owner)) + owner] = words.hashes()
        bounds = words.first + np.arange(n + 1)
        yield lo, bounds, found, np.r_[END, found[:-1]]


def bigrams(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _LEFT + mix(token + _RIGHT))


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(keys: np.ndarray, bits: int, kind: int, counts: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted distinct keys as a row a segment: (segment, width, keys[, n]); keys as differences of ``width`` bytes."""
    place = (keys >> U64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]][: len(place)])
    step = np.diff(keys, prepend=keys[:1])
    step[first] = keys[first] - (place[first].astype(U64) << U64(64 - bits))
    width = _width(step)
    bounds = np.r_[first, len(keys)]
    for lo in range(0, len(first), 10_000):
        part = bounds[lo : lo + 10_001]
        own = slice(part[0], part[-1])
        columns = {"segment": pa.array(place[part[:-1]] + (kind << bits)), "width": pa.array(np.full(len(part) - 1, width, np.int32)), "keys": _blobs(step[own], width, part - part[0])}
        if counts is not None:
            size = _width(counts[own].view(U64))
            columns |= {"n_width": pa.array(np.full(len(part) - 1, size, np.int32)), "n": _blobs(counts[own].view(U64), size, part - part[0])}
        yield pa.RecordBatch.from_pydict(columns)


def _width(values: np.ndarray) -> int:
    return max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1


def _blobs(values: np.ndarray, width: int, bounds: np.ndarray) -> pa.Array:
    """uint64 values as ``width`` bytes each, cut at bounds."""
    data = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(data)])


def _flat(column: pa.Array, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The uint64 values of a column of blobs whose rows have values of ``width`` bytes, and the rows' bounds."""
    if not len(column):
        return np.zeros(0, U64), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    bounds = np.r_[0, np.cumsum(np.diff(at) // width)]
    out = np.zeros((bounds[-1], 8), np.uint8)
    new = np.flatnonzero(np.r_[True, width[1:] != width[:-1]][: len(width)])
    for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(width)], strict=True):
        out[bounds[lo] : bounds[hi], : width[lo]] = data[at[lo] : at[hi]].reshape(-1, width[lo])
    return out.view("<u8")[:, 0], bounds


def unpacked(batch: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of rows that ``packed`` made, and the rows' bounds."""
    step, bounds = _flat(batch["keys"], batch["width"].to_numpy())
    total = np.r_[U64(0), np.cumsum(step)]
    base = (batch["segment"].to_numpy().astype(U64) & U64((1 << bits) - 1)) << U64(64 - bits)
    return total[1:] + np.repeat(base - total[bounds[:-1]], np.diff(bounds)), bounds


PACKED = "segment int, width int, keys binary"


def _counting(bits: int, most: int = 4_000_000):
    """Map side: keys of a segment and their counts, combined in the task; bigrams' segments follow those of words."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(held):
            if parts:
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                yield from packed(keys, bits, kind, counts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        size = 0
        for batch in batches:
            for _, _, token, before in tokens(batch["text"]):
                held[0].append(token)
                held[1].append(bigrams(before, token))
                size += len(token)
                if size > most:
                    yield from flush(held)
                    size = 0
        yield from flush(held)

    return work


def quantised(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def entry(keys: np.ndarray, level: np.ndarray | int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The place among ``words`` words, and the bits there, of the entry (key, level)."""
    e = mix(keys + _STEP * np.asarray(level).astype(U64))
    mask = np.zeros(len(e), U64)
    for i in range(PROBES):
        mask |= U64(1) << ((e >> U64(6 * i)) & U64(63))
    return ((e >> U64(32)) * np.asarray(words).astype(U64)) >> U64(32), mask


def _segment_blob(s: int, bits: int, key: np.ndarray, n: np.ndarray) -> tuple[bytes, int, int]:
    """A segment's file, its size in words and its tokens."""
    keys, counts = combine(key.view(U64), n)
    if s < 1 << bits:
        return keys.tobytes() + counts.tobytes(), len(keys), int(counts.sum())
    level = quantised(counts)
    size = max(1, int(level.sum()) * BITS // 64 + 1)
    table = np.zeros(size, U64)
    left = np.arange(len(keys))
    for j in range(1, int(level.max()) + 1):
        left = left[level[left] >= j]
        place, mask = entry(keys[left], j, size)
        np.bitwise_or.at(table, place.astype(np.int64), mask)
    return table.tobytes(), size, int(counts.sum())


def _building(root: str, bits: int):
    """Reduce side, of rows sorted by segment: writes one segment at a time; (segment, size in words, tokens)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []

        def built() -> pa.RecordBatch:
            blob, size, tokens_of = _segment_blob(now, bits, *(np.concatenate(x) for x in zip(*held, strict=True)))
            write_file(f"{root}/{now}.bin", blob)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([size], pa.int64()), pa.array([tokens_of], pa.int64())], ["segment", "size", "tokens"])

        for batch in batches:
            segment = batch["segment"].to_numpy()
            key, at = unpacked(batch, bits)
            n = _flat(batch["n"], batch["n_width"].to_numpy())[0].view(np.int64)
            bounds = np.r_[np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]][: len(segment)]), len(segment)]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if held and segment[lo] != now:
                    yield built()
                now = int(segment[lo])
                held.append((key[at[lo] : at[hi]].copy(), n[at[lo] : at[hi]].copy()))
        if held:
            yield built()

    return work


class Model:
    """Counts of words and quantised counts of bigrams, read from segments or from one file each."""

    def __init__(self, root: str, bits: int, total: int, distinct: int, sizes: dict[int, int] | None):
        self.root, self.bits, self.total, self.distinct, self.sizes = root, bits, total, distinct, sizes
        self._open: dict[str, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _segment(self, s: int) -> np.ndarray:
        if s not in self._open:
            if len(self._open) > 64:
                self._open.clear()
            self._open[s] = read_file(f"{self.root}/{s}.bin")
        return self._open[s]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct words."""
        if self.sizes is not None:
            if "words" not in self._open:
                table = read_file(f"{self.root}/words.bin")
                self._open["words"] = table[: len(table) // 2], table[len(table) // 2 :]
            return _find(*self._open["words"], keys)
        out, segment = np.zeros(len(keys), np.int64), (keys >> U64(64 - self.bits)).astype(np.int64)
        for s in np.unique(segment).tolist():
            table, here = self._segment(s), segment == s
            out[here] = _find(table[: len(table) // 2], table[len(table) // 2 :], keys[here])
        return out

    def levels(self, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The quantised counts of those bigrams that are asked for, by repeated probes."""
        out, left = np.zeros(len(keys), np.int64), np.flatnonzero(asked)
        segment = (keys >> U64(64 - self.bits)).astype(np.int64) + (1 << self.bits)
        if self.sizes is not None:
            if "filter" not in self._open:
                size = np.array([self.sizes.get(s, 0) for s in range(1 << self.bits, 2 << self.bits)], np.int64)
                self._open["filter"] = read_file(f"{self.root}/filter.bin"), size, np.cumsum(size) - size
            table, size, base = self._open["filter"]
            segment -= 1 << self.bits
            self._probe(table, size[segment], base[segment], keys, left, out)
            return out
        for s in np.unique(segment[left]).tolist():
            table, own = self._segment(s), left[segment[left] == s]
            self._probe(table, np.full(len(keys), len(table)), np.zeros(len(keys), np.int64), keys, own, out)
        return out

    @staticmethod
    def _probe(table, size, base, keys, left, out) -> None:
        left, level = left[size[left] > 0], 0
        while len(left):
            level += 1
            place, mask = entry(keys[left], level, size[left])
            left = left[(table[place.astype(np.int64) + base[left]] & mask) == mask]
            out[left] += 1

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.total + self.distinct + 1)

    def mixed(self, level: np.ndarray, of_before: np.ndarray, of_token: np.ndarray) -> np.ndarray:
        count = np.minimum(np.where(level > 0, BASE ** (level - 1.0), 0), np.minimum(of_before, of_token))
        known = of_before > 0
        return np.where(known, MIX * count / np.maximum(of_before, 1) + (1 - MIX) * self.unigram(of_token), self.unigram(of_token))


def _find(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked), np.int64)
    at = np.searchsorted(keys, asked)
    at[at == len(keys)] = 0
    return np.where(keys[at] == asked, counts[at].view(np.int64), 0)


def fit(docs: DataFrame, scratch: Scratch, model_bytes: int = MODEL_BYTES) -> Model:
    """Count all rows of docs."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, (size // SEGMENT_BYTES).bit_length())
    root = f"{scratch.root}/model"
    rows = docs.mapInArrow(_counting(bits), f"{PACKED}, n_width int, n binary").repartition("segment").sortWithinPartitions("segment")
    parts = scratch.save(rows.mapInArrow(_building(root, bits), "segment int, size bigint, tokens bigint"), "segments", tidy=True)
    of_word = F.col("segment") < (1 << bits)
    total, distinct, words = parts.agg(F.sum(F.when(of_word, F.col("tokens"))), F.sum(F.when(of_word, F.col("size"))), F.sum(F.when(~of_word, F.col("size")))).first()
    total, distinct, words = total or 0, distinct or 0, words or 0
    if 16 * distinct + 8 * words > model_bytes:

        def empty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for s in batch["segment"].to_pylist():
                    write_file(f"{root}/{s}.bin", b"")
                yield batch

        every = docs.sparkSession.range(2 << bits).select(F.col("id").cast("int").alias("segment"))
        scratch.save(every.join(parts.select("segment"), "segment", "left_anti").mapInArrow(empty, "segment int"), "empty")
        return Model(root, bits, total, distinct, None)
    sizes = {r.segment: r.size for r in parts.select("segment", "size").collect()}  # a model of model_bytes has few

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        of_words, of_pairs = ([s for s in sorted(sizes) if (s < 1 << bits) == kind] for kind in (True, False))
        half = lambda t, k: t[k * len(t) // 2 : (k + 1) * len(t) // 2]
        # Segment by segment: first all keys, then all counts.
        write_parts(f"{root}/words.bin", (half(read_file(f"{root}/{s}.bin"), k) for k in (0, 1) for s in of_words))
        write_parts(f"{root}/filter.bin", (read_file(f"{root}/{s}.bin") for s in of_pairs))
        yield pa.RecordBatch.from_arrays([pa.array([len(sizes)], pa.int64())], ["n"])

    docs.sparkSession.range(1).coalesce(1).mapInArrow(assemble, "n bigint").collect()
    return Model(root, bits, total, distinct, sizes)


FOUND = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _summed(model: Model, doc_id: pa.Array, text: pa.Array, counts, levels) -> pa.RecordBatch:
    """Scores of some texts; counts: of sorted distinct words, levels: of bigrams where asked for."""
    parts = []
    for _, bounds, token, before in tokens(text):
        keys, at = np.unique(token, return_inverse=True)
        of_token = counts(keys)[at]
        of_before = np.r_[counts(np.array([END]))[:1], of_token[:-1]]
        level = levels(bigrams(before, token), (of_token > 0) & (of_before > 0))
        first = bounds[:-1]
        logs = (np.log10(model.unigram(of_token)), np.log10(model.mixed(level, of_before, of_token)))
        parts.append([np.diff(bounds), np.add.reduceat((of_token > 0).astype(np.int64), first), *[np.add.reduceat(x, first) for x in logs]])
    columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)] if parts else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
    return pa.RecordBatch.from_arrays([doc_id, *columns], ["doc_id", "n_tokens", "n_known", "base_score", "score"])


def _whole(model: Model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _summed(model, batch["doc_id"], batch["text"], model.counts, model.levels)

    return work


def _chunks(most: int):
    """Gather documents to rows of about ``most`` bytes of text, each a table in Arrow's format; a longer text is one of its own."""

    def blob(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            for part in parts:
                to.write_batch(part)
        return pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo, hi, data, _ in runs(batch["text"]):
                if held and size + len(data) > most:
                    yield blob(held)
                    held, size = [], 0
                # Slices of a batch would be written with its whole buffers' life; a copy is as long as its run.
                held.append(batch.slice(lo, hi - lo).take(pa.array(np.arange(hi - lo))))
                size += len(data)
        if held:
            yield blob(held)

    return work


def _opened(docs: pa.Scalar) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(docs.as_buffer())


def _asked(docs: pa.Scalar) -> list[np.ndarray]:
    """The distinct words and bigrams of a chunk, sorted."""
    held: list[list[np.ndarray]] = [[], []]
    for part in _opened(docs):
        for _, _, token, before in tokens(part["text"]):
            held[0].append(np.unique(token))
            held[1].append(np.unique(bigrams(before, token)))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, U64) for x in held]


def _chunk_file(root: str, chunk: int) -> str:
    return f"{root}/answers/{chunk}.bin"


def _chunked(docs: DataFrame, model: Model, scratch: Scratch) -> DataFrame:
    """Scores when the model is too large for a worker: chunks ask the segments for what they hold, once each."""
    bits = model.bits
    root = scratch.root
    chunks = scratch.save(docs.mapInArrow(_chunks(CHUNK_BYTES), "docs binary").withColumn("chunk", F.monotonically_increasing_id()), "chunks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch["chunk"].to_pylist(), batch["docs"], strict=True):
                for kind, keys in enumerate(_asked(docs)):
                    for rows in packed(keys, bits, kind):
                        yield rows.append_column("chunk", pa.array(np.full(rows.num_rows, chunk, np.int64)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bounds = unpacked(batch, bits)
            segment = batch["segment"].to_numpy()
            words = int(np.searchsorted(segment, 1 << bits))  # rows are sorted by segment
            cut = bounds[words]
            counts, levels = model.counts(keys[:cut]), model.levels(keys[cut:], np.ones(len(keys) - cut, bool))
            total = np.r_[U64(0), np.cumsum(mix(keys))]
            mark = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)
            for lo, hi, values, width in ((0, words, counts, 8), (words, batch.num_rows, np.minimum(levels, 255), 1)):
                own = bounds[lo : hi + 1] - bounds[lo]
                yield pa.RecordBatch.from_arrays([batch["chunk"].slice(lo, hi - lo), pa.array(segment[lo:hi]), pa.array(mark[lo:hi]), _blobs(values.view(U64), width, own)], ["chunk", "segment", "mark", "answer"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are sorted by chunk and segment: answers stand in the order of the chunk's keys, words first.
        now, mark, held = -1, U64(0), ([], [])

        def written() -> pa.RecordBatch:
            blobs = [np.concatenate(x).tobytes() if x else b"" for x in held]
            small = [pa.compress(x, "zstd", asbytes=True) for x in blobs]
            head = np.array([mark, *map(len, blobs), *map(len, small)], U64).tobytes()
            body = head + b"".join(small)
            write_file(_chunk_file(root, now), body + b"\0" * (-len(body) % 8))
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64())], ["chunk"])

        for batch in batches:
            chunk, segment, marks = (batch[c].to_numpy() for c in ("chunk", "segment", "mark"))
            of_word = segment < 1 << bits
            data, at = _flat(batch["answer"], np.where(of_word, 8, 1))
            new = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]][: len(chunk)])
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(chunk)], strict=True):
                if now >= 0 and chunk[lo] != now:
                    yield written()
                    mark = U64(0)
                now, cut = int(chunk[lo]), lo + int(of_word[lo:hi].sum())
                mark = np.add.reduce(np.r_[mark, marks[lo:hi].view(U64)])
                held[0].append(data[at[lo] : at[cut]].copy())
                held[1].append(data[at[cut] : at[hi]].astype(np.uint8))
        if now >= 0:
            yield written()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, docs in zip(batch["chunk"].to_pylist(), batch["docs"], strict=True):
                words, pairs = _asked(docs)
                body = read_file(_chunk_file(root, chunk)).tobytes()
                mark, *sizes = np.frombuffer(body[:40], U64).tolist()
                bounds = 40 + np.cumsum([0, *sizes[2:]])
                of_word, of_pair = (np.frombuffer(pa.decompress(body[bounds[i] : bounds[i + 1]], sizes[i], "zstd", asbytes=True), kind) for i, kind in enumerate((np.int64, np.uint8)))
                if (len(of_word), len(of_pair)) != (len(words), len(pairs)) or int(np.add.reduce(mix(words))) + int(np.add.reduce(mix(pairs))) - mark & (1 << 64) - 1:
                    raise ValueError(f"answers of chunk {chunk} are not to its own words")
                counts = lambda keys, w=words, n=of_word: n[np.searchsorted(w, keys)]
                levels = lambda keys, asked, p=pairs, n=of_pair: np.where(asked, n[np.searchsorted(p, keys)], 0)
                for part in _opened(docs):
                    yield _summed(model, part["doc_id"], part["text"], counts, levels)

    asked = chunks.mapInArrow(ask, f"{PACKED}, chunk bigint").repartition("segment").sortWithinPartitions("segment")
    answers = scratch.save(asked.mapInArrow(answer, "chunk bigint, segment int, mark bigint, answer binary"), "answers", tidy=True)
    filed = answers.repartition("chunk").sortWithinPartitions("chunk", "segment").mapInArrow(file, "chunk bigint")
    scratch.save(filed, "filed", tidy=True)
    scratch.drop(answers)
    return scratch.save(chunks.mapInArrow(score, FOUND), "scores")


def lm_scores(docs: DataFrame, scratch: Scratch | None = None, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    scratch = scratch or Scratch(docs.sparkSession, "lm")
    texts = only(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    held = fold(F.col("doc_id"), FOLDS) == HELD
    model = fit(texts.where(~held), scratch, model_bytes)
    if model.sizes is not None:
        found = texts.mapInArrow(_whole(model), FOUND)
    else:
        found = _chunked(texts, model, scratch)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op5_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lm_scoring": op5_lm_scoring}
