"""Connected components of a large edge list, by repeated merging and pointer jumping.

Every round is a few equi-joins and aggregates; its result is written to the shared folder, so a
lost executor costs one round at most. Links never pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import ship_with_tasks, written_table

ship_with_tasks(__name__)
FLUSH_ROWS = 2_000_000


def smallest_labels(n: int, owner: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For items 0..n-1 that share groups (pairs owner, group): the smallest item reachable."""
    label = np.arange(n)
    order = np.argsort(group, kind="stable")
    own, key = owner[order], group[order]
    if not len(key):
        return label
    new = np.append(True, key[1:] != key[:-1])
    starts, run = np.flatnonzero(new), np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1
    own, run = own[shared], run[shared]
    if not len(own):
        return label
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    while True:
        low = np.repeat(np.minimum.reduceat(label[own], starts), sizes)
        better = label.copy()
        np.minimum.at(better, own, low)
        np.minimum.at(better, label[own], low)
        better = better[better]
        if np.array_equal(better, label):
            return label
        label = better


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges seen together by one edge from each node to its smallest local node."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = smallest_labels(len(nodes), at, np.tile(np.arange(len(a)), 2))
        moved = label != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], ["node", "root"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        if sum(len(x[0]) for x in held) >= FLUSH_ROWS:
            yield flush()
            held.clear()
    if held:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node that has an edge, except from the smallest itself.

    ``edges`` has two bigint columns without nulls; loops and repeated edges are allowed. Returns
    node, root. Nodes that are their own root are left out; an empty table gives an empty table.
    """
    a, b = edges.columns[:2]
    clean = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = clean.mapInArrow(_contract, "node long, root long")
    while True:
        low = F.min("root").over(Window.partitionBy("node"))
        seen = links.withColumn("low", low)
        apart = F.col("root") != F.col("low")
        pairs = F.when(
            apart,
            F.array(
                F.struct(F.col("node").alias("node"), F.col("low").alias("root"), F.lit(1).alias("open")),
                F.struct(F.col("root").alias("node"), F.col("low").alias("root"), F.lit(1).alias("open")),
            ),
        ).otherwise(F.array(F.struct(F.col("node").alias("node"), F.col("root").alias("root"), F.lit(0).alias("open"))))
        merged = seen.select(F.inline(pairs)).groupBy("node", "root").agg(F.max("open").alias("open"))
        parents = merged.groupBy(F.col("node").alias("below")).agg(F.min("root").alias("above"))
        jumped = merged.join(parents, merged["root"] == parents["below"], "left").select(
            "node",
            F.coalesce("above", "root").alias("root"),
            F.greatest("open", F.when(F.col("above").isNull(), 0).otherwise(1)).alias("open"),
        )
        done = written_table(jumped, "components")
        links = done.select("node", "root").distinct()
        if done.where("open = 1").isEmpty():
            return links
