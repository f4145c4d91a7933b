"""Exact nearest neighbours within a class, without pairing all rows of the class.

Distinct points are cut into tiles of bounded size by a k-d tree, so tiles stay compact in any number
of columns. Each tile answers its own points; the distance to the k-th neighbour found there bounds
what is missing, and only tiles whose bounding box comes closer than that are asked as well. Boxes
form two levels: those of tile groups are held by every task, which descends a tree of boxes over
them; those inside are joined as a table. The result is exact for any tiling; the tiling only decides
how many tiles are asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.shared import LOOKUP_ROWS, ship_with_tasks, written_table

ship_with_tasks(__name__)

_TILE_BITS = 11
# Points that one task cuts into tiles, regions that one tree may have, and sampled points per region.
_REGION_POINTS = 1 << 17
_REGIONS = 1 << 14
_SAMPLED = 16
_REGION_SHIFT = 32
_CELLS_PER_CHUNK = 1 << 22
# Boxes of tile groups that the driver may hold, and visitors of a tile that one task answers.
_GROUPS = LOOKUP_ROWS // 2
_VISITORS = 1 << 14
# Queries that descend the boxes at once; each may meet all groups of its class.
_ASKED = 256


def _halves(x: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the points in k-d order, cut into parts of at most ``size``: always the widest column, at its middle."""
    done, open_parts = [], [np.arange(len(x))]
    while open_parts:
        part = open_parts.pop()
        if len(part) <= size:
            done.append(part)
            continue
        values = x[part]
        axis = int(np.argmax(values.max(axis=0) - values.min(axis=0)))
        middle = len(part) // 2
        order = np.argpartition(values[:, axis], middle)
        open_parts += [part[order[middle:]], part[order[:middle]]]
    return done


def _grow(sample: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axis, cut and low child of each node of a k-d tree over sampled points; a leaf's axis is -1 and its
    child its number. Children are neighbours, and leaves are numbered from left to right.

    A node is cut at the middle value of its widest column, so that points with one value stay on one side.
    """
    least = max(2 * len(sample) // max(regions, 1), 2)
    axes, cuts, child = [-1], [0.0], [0]
    leaves, stack = 0, [(0, sample)]
    while stack:
        node, points = stack.pop()
        low, high = (points.min(axis=0), points.max(axis=0)) if len(points) else (np.zeros(1), np.zeros(1))
        axis = int(np.argmax(high - low))
        if len(points) < least or not high[axis] > low[axis]:
            child[node] = leaves
            leaves += 1
            continue
        values = points[:, axis]
        cut = float(np.partition(values, len(values) // 2)[len(values) // 2])
        if not cut > low[axis]:
            cut = float(values[values > cut].min())
        axes[node], cuts[node], child[node] = axis, cut, len(axes)
        axes += [-1, -1]
        cuts += [0.0, 0.0]
        child += [0, 0]
        below = values < cut
        stack += [(child[node] + 1, points[~below]), (child[node], points[below])]
    return np.array(axes), np.array(cuts), np.array(child)


def _descend(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Number of the leaf that holds each point."""
    axes, cuts, child = tree
    node = np.zeros(len(x), np.int64)
    inner = np.flatnonzero(axes[node] >= 0)
    while len(inner):
        at = node[inner]
        node[inner] = child[at] + (x[inner, axes[at]] >= cuts[at])
        inner = inner[axes[node[inner]] >= 0]
    return child[node]


def _matrix(table: pa.Table | pa.RecordBatch, numbers: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in numbers])


def _regions(df: DataFrame, label: str, numbers: Sequence[str]) -> DataFrame:
    """Points with a ``region`` of their class: that of a k-d tree over sampled points, 0 in small classes."""
    large = df.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") > _REGION_POINTS).collect()
    # As many rows as regions at most: a class listed here has more points than a region.
    total = sum(r["n"] for r in large)
    per_region = max(_REGION_POINTS, -(-total // _REGIONS))
    one_in = max(per_region // _SAMPLED, 1)
    names = df.sparkSession.createDataFrame([(r[label],) for r in large], df.select(F.col(label).alias("__large")).schema)
    drawn = df.join(F.broadcast(names), df[label].eqNullSafe(F.col("__large")), "left_semi").where(
        F.pmod(F.xxhash64("rep"), F.lit(one_in)) == 0
    )
    # _SAMPLED points per region, so _SAMPLED * _REGIONS at most.
    sample = drawn.select(label, *[F.col(c).cast("double").alias(c) for c in numbers]).toPandas()
    parts = {cls: g[list(numbers)].to_numpy(float) for cls, g in sample.groupby(label, dropna=False)}
    sizes = {r[label]: -(-r["n"] // per_region) for r in large}
    trees = {cls: _grow(points, sizes.get(cls, 1)) for cls, points in parts.items()}
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = np.zeros(batch.num_rows, np.int64)
            labels = batch.column(label).dictionary_encode()
            codes = labels.indices.to_numpy(zero_copy_only=False)
            for code, cls in enumerate(labels.dictionary.to_pylist()):
                if cls in shared.value:
                    mine = np.flatnonzero(codes == code)
                    region[mine] = _descend(shared.value[cls], _matrix(batch, numbers)[mine])
            yield batch.append_column("region", pa.array(region))

    return df.mapInArrow(place, _with(df, "region"))


def _with(df: DataFrame, column: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], f"{column} bigint"])


def tile_points(df: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], points: int) -> DataFrame:
    """Points with their ``tile``: at most 2 ** _TILE_BITS points of one class that are close in all numbers.

    A k-d tree over a sample cuts the classes into regions, which are shuffled; a task halves its region on,
    in memory, down to tiles. ``points`` bounds their number; where one region may hold all points nothing is
    sampled. Tiles are numbered in tree order, so neighbours have near numbers. They depend on the order of
    rows within a region, so they are written down once and read back.

    Regions hold some 131,000 points each up to 2 billion points, in proportion more beyond. Points that
    agree in all numbers and differ in ``categories`` only are one region, however many there are.
    """
    if points > _REGION_POINTS:
        placed = _regions(written_table(df, "points"), label, numbers)
    else:
        placed = df.withColumn("region", F.lit(0).cast("bigint"))
    bits = _TILE_BITS

    def cut(region: pa.Table) -> pa.Table:
        parts = _halves(_matrix(region, numbers), 1 << bits)
        tile = np.empty(region.num_rows, np.int64)
        for number, part in enumerate(parts):
            tile[part] = number
        base = region.column("region")[0].as_py() << _REGION_SHIFT
        return region.drop_columns(["region"]).append_column("tile", pa.array(tile + base))

    tiled = placed.groupBy(label, "region").applyInArrow(cut, _with(df, "tile"))
    return written_table(tiled, "tiles")


def _numbered(boxes: DataFrame, label: str) -> DataFrame:
    """Boxes with a group: neighbouring tiles of a class, so many that the groups stay a bounded lookup."""
    width = -(-boxes.count() // _GROUPS)
    place = F.row_number().over(Window.partitionBy(label, "slice").orderBy("tile")) - 1
    # Tiles of one region have consecutive numbers, which start anew in the next one.
    sliced = boxes.withColumn("slice", F.shiftright("tile", _REGION_SHIFT))
    return sliced.withColumn("group", F.struct("slice", F.floor(place / width).alias("part")))


def _nearest(
    queries: pd.DataFrame, points: pd.DataFrame, k: int, numbers: Sequence[str], categories: Sequence[str], own: bool
) -> list[np.ndarray]:
    """Per query the positions and squared distances of its k nearest points, ties by point order."""
    q = queries[list(numbers)].to_numpy(float)
    p = points[list(numbers)].to_numpy(float)
    rows, cols = len(q), len(p)
    position = np.full((rows, k), -1)
    distance = np.full((rows, k), np.inf)
    codes = [_codes(queries[c], points[c]) for c in categories]
    chunk = max(1, _CELLS_PER_CHUNK // max(cols, 1))
    for start in range(0, rows, chunk):
        part = slice(start, min(start + chunk, rows))
        squared = np.zeros((part.stop - start, cols))
        for axis in range(len(numbers)):
            squared += (q[part, axis, None] - p[None, :, axis]) ** 2
        for ours, theirs in codes:
            a, b = ours[part, None], theirs[None, :]
            # A missing category has no one-hot column set, so it differs in one place, not two.
            squared += np.where(a != b, (a >= 0) * 1.0 + (b >= 0), 0.0)
        if own:
            squared[queries["rep"].to_numpy()[part, None] == points["rep"].to_numpy()[None, :]] = np.inf
        for step in range(min(k, cols)):
            # argmin takes the first of equal distances, that is the first in point order.
            best = squared.argmin(axis=1)
            index = np.arange(len(best))
            found = squared[index, best]
            position[part, step] = np.where(np.isinf(found), -1, best)
            distance[part, step] = found
            squared[index, best] = np.inf
    return [position, distance]


def _codes(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    both, _ = pd.factorize(pd.concat([a, b], ignore_index=True))
    return both[: len(a)], both[len(a) :]


def _found_frame(queries, points, k, numbers, categories, own) -> pd.DataFrame:
    """One row per query and neighbour, the neighbour's columns prefixed with ``nb_``."""
    position, distance = _nearest(queries, points, k, numbers, categories, own)
    query, step = np.nonzero(position >= 0)
    chosen = points.iloc[position[query, step]]
    out = pd.DataFrame({"rep": queries["rep"].to_numpy()[query], "distance": distance[query, step]})
    for name in ("copies", *numbers, *categories):
        out[f"nb_{name}"] = chosen[name].to_numpy()
    return out


def nearest_points(
    points: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], k: int
) -> DataFrame:
    """The k nearest other points of the same class for each point with ``asks`` set.

    ``points`` comes from ``tile_points`` and holds distinct points with columns ``rep`` (unique),
    ``copies`` and ``asks``. Squared distance adds 2 for each category that differs, which is what
    one-hot columns give. Result rows: (rep, distance, nb_copies, nb_<column>...).
    """
    spark = points.sparkSession
    numbers, categories = list(numbers), list(categories)
    order = [*numbers, *categories]
    rep_type = points.schema["rep"].dataType.simpleString()
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    found_schema = ", ".join(
        [f"rep {rep_type}", "distance double", "nb_copies bigint", *[f"nb_{c} {kinds[c]}" for c in order]]
    )

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(order, na_position="first", kind="stable")
        return _found_frame(ordered[ordered["asks"]], ordered, k, numbers, categories, True)

    inside = written_table(points.groupBy(label, "tile").applyInPandas(within, found_schema), "inside")

    edges = [*[F.min(c).alias(f"lo_{c}") for c in numbers], *[F.max(c).alias(f"hi_{c}") for c in numbers]]
    boxes = written_table(_numbered(points.groupBy(label, "tile").agg(*edges), label), "boxes")
    wide = [*[F.min(f"lo_{c}").alias(f"lo_{c}") for c in numbers], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in numbers]]
    groups = boxes.groupBy(label, "group").agg(*wide, F.count("*").alias("tiles"))
    # At most _GROUPS rows, plus one per class and region.
    group_rows = groups.select(
        label, "group.slice", "group.part", "tiles", *[f"{e}_{c}" for e in ("lo", "hi") for c in numbers]
    ).orderBy(label, "slice", "part").toPandas()
    if (group_rows.groupby(label, dropna=False)["tiles"].sum() <= 1).all():
        return inside

    reach = inside.groupBy("rep").agg(
        F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("reach")
    )
    asking = points.where("asks").select("rep", label, "tile", *order)
    open_queries = asking.join(reach, "rep", "left").na.fill(float("inf"), ["reach"])
    shared = spark.sparkContext.broadcast(_box_arrays(group_rows, label, numbers))
    coordinates = [f"{c} {kinds[c]}" for c in order]
    visit_schema = ", ".join(
        [f"rep {rep_type}", f"{label} {kinds[label]}", "tile bigint", "reach double", *coordinates,
         "slice bigint", "part bigint"]
    )

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for cls, group in pdf.groupby(label, dropna=False):
                yield from _visits(group, shared.value[cls], numbers, ["rep", label, "tile", "reach", *order])

    called = open_queries.mapInPandas(visits, visit_schema).withColumnRenamed("tile", "own")
    near = F.lit(0.0)
    for c in numbers:
        gap = F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0))
        near = near + gap * gap
    inner = boxes.select(
        F.col(label).alias("__label"), F.col("group.slice").alias("__slice"), F.col("group.part").alias("__part"),
        "tile", *[f"{e}_{c}" for e in ("lo", "hi") for c in numbers],
    )
    same = called[label].eqNullSafe(inner["__label"]) & (F.col("slice") == F.col("__slice")) & (F.col("part") == F.col("__part"))
    visiting = called.join(inner, same).where((near <= F.col("reach")) & (F.col("tile") != F.col("own")))
    # A tile with many visitors answers them in blocks, each in a task of its own.
    visiting = written_table(visiting.select("rep", label, "tile", *order), "visits")
    spread = visiting.groupBy(F.col(label).alias("__label"), F.col("tile").alias("__tile")).agg(
        F.ceil(F.count("*") / _VISITORS).cast("int").alias("__blocks")
    )

    def blocked(df: DataFrame, block: Column) -> DataFrame:
        matched = df[label].eqNullSafe(F.col("__label")) & (df["tile"] == F.col("__tile"))
        return df.join(spread, matched).withColumn("block", block).drop("__label", "__tile", "__blocks")

    askers = blocked(visiting, F.pmod(F.xxhash64("rep"), F.col("__blocks")).cast("int"))
    hosts = blocked(points, F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))

    def across(queries: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        ordered = tile.sort_values(order, na_position="first", kind="stable")
        return _found_frame(queries, ordered, k, numbers, categories, False)

    parties = [label, "tile", "block"]
    outside = askers.groupBy(*parties).cogroup(hosts.groupBy(*parties)).applyInPandas(across, found_schema)
    return inside.unionByName(outside)


def _box_arrays(boxes: pd.DataFrame, label: str, numbers: Sequence[str]) -> dict:
    """Per class the boxes of its tile groups, and above them boxes of two, four, ... neighbours in tree order."""
    out = {}
    for cls, group in boxes.groupby(label, dropna=False):
        lo = group[[f"lo_{c}" for c in numbers]].to_numpy(float)
        hi = group[[f"hi_{c}" for c in numbers]].to_numpy(float)
        levels = [(lo, hi)]
        while len(levels[-1][0]) > 1:
            starts = np.arange(0, len(levels[-1][0]), 2)
            levels.append((np.minimum.reduceat(levels[-1][0], starts), np.maximum.reduceat(levels[-1][1], starts)))
        out[cls] = {"slice": group["slice"].to_numpy(), "part": group["part"].to_numpy(), "levels": levels}
    return out


def _reached(x: np.ndarray, limit: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of query and lowest box within the query's reach, found from the one box over all downwards."""
    query, box = np.arange(len(x)), np.zeros(len(x), np.int64)
    for depth, (lo, hi) in enumerate(reversed(levels)):
        if depth:
            query, box = np.repeat(query, 2), np.repeat(box * 2, 2)
            box[1::2] += 1
            inside = box < len(lo)
            query, box = query[inside], box[inside]
        near = np.zeros(len(query))
        for axis in range(x.shape[1]):
            at = x[query, axis]
            near += np.maximum(np.maximum(lo[box, axis] - at, at - hi[box, axis]), 0) ** 2
        keep = near <= limit[query]
        query, box = query[keep], box[keep]
    return query, box


def _visits(group: pd.DataFrame, boxes: dict, numbers: Sequence[str], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Queries paired with the tile groups whose box is within their reach, some hundred queries at a time."""
    x = group[list(numbers)].to_numpy(float)
    limit = group["reach"].to_numpy(float)
    for start in range(0, len(x), _ASKED):
        part = slice(start, start + _ASKED)
        query, box = _reached(x[part], limit[part], boxes["levels"])
        if len(query):
            out = group.iloc[start + query][columns].copy()
            out["slice"] = boxes["slice"][box]
            out["part"] = boxes["part"][box]
            yield out
