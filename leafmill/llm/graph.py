"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.exact_dedup import attach, weigh
from leafmill.llm.scratch import Scratch

#: Edges that one task may hold; beyond it the star algorithm runs on tables.
TASK_EDGES = 1_000_000


def labels_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _stars(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One large-star or small-star step; edges are (a, b), each once, a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    centres = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n")), "centres")
    joined = attach(both, centres, ["a"], weigh(centres))
    moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(centres.select("a", F.col("m").alias("b")))
    return scratch.save(moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")


def components(edges: DataFrame, scratch: Scratch, task_edges: int = TASK_EDGES, at_most: int | None = None) -> DataFrame:
    """(node, component) of all nodes that have an edge (a, b); component: the smallest node reached.

    at_most: a bound of the number of edges where the caller has counted them.
    """
    edges = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if (at_most if at_most is not None and at_most <= task_edges else edges.count()) <= task_edges:

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = list(batches)
            if held:
                table = pa.Table.from_batches(held)
                nodes, label = labels_of(table["a"].to_numpy(), table["b"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(label)], ["node", "component"])

        return scratch.save(edges.coalesce(1).mapInArrow(solve, "node bigint, component bigint"), "labels")
    state = edges
    while True:
        new = _stars(_stars(state, True, scratch), False, scratch)
        # Settled when every node has one centre, and that has no edge of its own.
        done = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty() and new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        state = new
        if done:
            break
    return scratch.save(state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "labels")
