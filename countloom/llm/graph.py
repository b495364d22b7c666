"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm._spark import cut, forget

#: A graph of up to so many edges (16 bytes each) is solved by union-find in one task; a larger one by joins.
TASK_EDGES = 1_000_000


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of the task: labels sink to the least neighbour's and paths are halved until nothing moves."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at[: len(at) // 2], at[len(at) // 2 :]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, top[a], low)
        np.minimum.at(new, top[b], low)
        new = new[new]
        if np.array_equal(new, top):
            break
        top = new
    yield pa.RecordBatch.from_pydict({"key": pa.array(nodes), "label": pa.array(nodes[top])})


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(key, label) of every key in ``edges`` (a, b; long): the least key that it is connected with.

    Beyond ``task_edges`` edges, each round takes the least label of the
    neighbours and then the label of that label, so paths halve; rounds end when
    no label changes. Labels are written to the shared folder after each round.
    """
    given = cut(edges.select("a", "b").where(F.col("a") != F.col("b")))
    if given.count() <= task_edges:
        out = cut(given.coalesce(1).mapInArrow(_solve, "key long, label long"))
        forget(given)
        return out
    both = cut(given.union(given.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("key")).alias("label")))
    while True:
        near = both.join(labels, F.col("b") == F.col("key")).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, F.col("key") == F.col("a")).select("key", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        jump = labels.select(F.col("key").alias("at"), F.col("label").alias("onto"))
        new = cut(step.join(jump, F.col("label") == F.col("at"), "left").select("key", "was", F.least("label", F.coalesce("onto", "label")).alias("label")))
        done = new.where(F.col("was") != F.col("label")).isEmpty()
        forget(labels)
        labels = new.select("key", "label")
        if done:
            forget(both)
            forget(given)
            return labels
