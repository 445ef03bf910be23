"""Best-fit packing of tokenised documents by hierarchical residual packing (operator 6).

Every document becomes its token ids and an end id.  Longer ones are cut into
full pieces, with the remainder as first piece.  Partitions pack their pieces
best-fit, longest first.  Nearly full bins are emitted; underfull bins are the
items of the next round, in which several partitions merge into one, until
one task holds all that are left or the limit of items a task is reached.
Only metadata of pieces travels, never their ids; ``sequences`` gives those.

Cases: a null or empty text is its end id alone; pieces of equal length go in
the order they came in; very long texts are cut into pieces; an empty table
gives an empty one; rows without doc_id are left out; repeated rows and rows
that share a doc_id are packed each on their own; columns other than doc_id and
text are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.scratch import Scratch, only

SEQUENCE, END_ID, NEARLY_FULL, FAN_IN, TASK_ITEMS = 1024, 2, 4, 8, 250_000
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
_BINS = pa.schema([("fill", pa.int32()), ("sequence_id", pa.int64()), ("members", pa.list_(MEMBER))])
_loaded: dict[str, tuple] = {}


def tokenizer(vocabulary: str):
    """A function from a text to the ids that the vocabulary file's tokenizer gives, specials not added.

    The ranks of the same vocabulary serve a faster library where they lie
    beside it; texts that spell a special token go to the file's own tokenizer.
    """
    if vocabulary not in _loaded:
        from pathlib import Path

        special = [t["content"] for t in json.loads(Path(vocabulary).read_text(encoding="utf-8")).get("added_tokens", [])]
        ranks = Path(vocabulary).with_suffix(".tiktoken")
        fast = None
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        _loaded[vocabulary] = special, fast
    special, fast = _loaded[vocabulary]

    def ids(text: str) -> list[int]:
        if fast is None or any(s in text for s in special):
            return _own(vocabulary).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


@lru_cache
def _own(vocabulary: str):
    """The file's own tokenizer; most tasks never need it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones after a first of what remains."""
    first = n % size or size
    return [(0, first)] + [(at, size) for at in range(first, n, size)]


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6 if with_ids else 5)]
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                found = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                for k, (start, length) in enumerate(cuts(len(found), size)):
                    part = found[start : start + length]
                    for to, value in zip(rows, (doc, k, start, length, zlib.crc32(part.tobytes()), part), strict=False):
                        to.append(value)
            arrays = [pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=False)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array([x.astype(np.int64) for x in rows[5]], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return only(docs, "doc_id", "text").where("doc_id IS NOT NULL").mapInArrow(cut, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the items of each bin: longest first, each into the fullest bin that holds it."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    residuals = 0  # bit r: a bin with r left is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = residuals >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                residuals &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        if left:
            open_at[left].append(b)
            residuals |= 1 << left
    return bins


def _packed(fill: np.ndarray, members: pa.ListArray, capacity: int, level: int, made: int) -> pa.RecordBatch:
    """The bins of one chunk of a task that has made so many bins before."""
    bins = best_fit(fill, capacity)
    offsets, flat = members.offsets.to_numpy(), members.values
    order = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for b in bins for i in b]) if bins else np.zeros(0, np.int64)
    widths = np.array([sum(int(offsets[i + 1] - offsets[i]) for i in b) for b in bins], dtype=np.int64)
    bounds = pa.array(np.concatenate([[0], np.cumsum(widths)]).astype(np.int32))
    task = TaskContext.get()
    base = (level << 56) | ((task.partitionId() if task else 0) << 32)
    filled = pa.array([int(fill[b].sum()) for b in bins], pa.int32())
    return pa.RecordBatch.from_arrays([filled, pa.array(base + made + np.arange(len(bins)), pa.int64()), pa.ListArray.from_arrays(bounds, flat.take(pa.array(order)))], schema=_BINS)


def pack(cut: DataFrame, scratch: Scratch, size: int = SEQUENCE, fan_in: int = FAN_IN, task_items: int = TASK_ITEMS) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset."""

    def gather(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        # A task packs at most task_items at once, so its memory is bounded.
        held: list[pa.RecordBatch] = []
        made = 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= task_items:
                for bins in work(held, level, made):
                    made += bins.num_rows
                    yield bins
                held = []
        yield from work(held, level, made)

    def work(held: list[pa.RecordBatch], level: int, made: int) -> Iterator[pa.RecordBatch]:
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held).combine_chunks()
        if level:
            members = table["members"].chunk(0)
            if members.offset:
                members = pa.concat_arrays([members, members.slice(0, 0)])
            yield _packed(table["fill"].to_numpy().astype(np.int64), members, size, level, made)
        else:
            flat = pa.StructArray.from_arrays([table[f.name].chunk(0).cast(f.type) for f in MEMBER], fields=list(MEMBER))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1), pa.int32()), flat)
            yield _packed(table["length"].to_numpy(), each, size, 0, made)

    schema = f"fill int, sequence_id bigint, members {MEMBERS}"
    full = size - NEARLY_FULL
    round_of = scratch.save(cut.mapInArrow(lambda b: gather(b, 0), schema), "bins")
    emitted, level = [round_of.where(F.col("fill") >= full)], 0
    rest = round_of.where(F.col("fill") < full)
    known = rest.agg(F.count("*"), F.min("fill")).first()
    tasks = max(1, rest.rdd.getNumPartitions()) if known[0] else 1
    while known[0]:
        # Bins to which not even the smallest open one can be added are as full as they get.
        stuck = F.col("fill") + F.lit(known[1]) > size
        emitted.append(rest.where(stuck))
        rest, before = rest.where(~stuck), known[0]
        open_bins = rest.count()
        if not open_bins:
            break
        level += 1
        tasks = max(-(-tasks // fan_in), -(-open_bins // task_items))
        round_of = scratch.save(rest.coalesce(tasks).mapInArrow(lambda b, n=level: gather(b, n), schema), "bins")
        if tasks == 1 or level == 127:  # sequence ids hold no more levels
            emitted.append(round_of)
            break
        emitted.append(round_of.where(F.col("fill") >= full))
        rest = round_of.where(F.col("fill") < full)
        known = rest.agg(F.count("*"), F.min("fill")).first()
        if known[0] >= before and tasks == -(-open_bins // task_items):
            emitted.append(rest)  # no task could merge any more within its bound
            break

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            members = batch["members"]
            flat, owner = members.flatten(), pa.compute.list_parent_indices(members)
            lengths = flat.field("length").to_numpy()
            ends, owners = np.cumsum(lengths), owner.to_numpy()
            begin = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            base = np.repeat((ends - lengths)[begin], np.diff(np.r_[begin, len(owners)]))
            yield pa.RecordBatch.from_arrays([*flat.flatten(), batch["sequence_id"].take(owner), pa.array(ends - lengths - base)], [*[f.name for f in MEMBER], "sequence_id", "offset"])

    whole = emitted[0]
    for x in emitted[1:]:
        whole = whole.unionByName(x)
    return whole.mapInArrow(lay_out, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, scratch: Scratch | None = None) -> DataFrame:
    """Placements of all pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    cut = scratch.save(pieces(docs, vocabulary or default_vocabulary(), size), "pieces")
    return pack(cut, scratch, size)


def sequences(docs: DataFrame, placements: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """(sequence_id, ids) of packed documents with distinct doc_ids: the training sequences themselves."""
    ids = pieces(docs, vocabulary or default_vocabulary(), size, with_ids=True).select("doc_id", "piece", "ids")
    placed = placements.select("doc_id", "piece", "sequence_id", "offset").join(ids, ["doc_id", "piece"])
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
