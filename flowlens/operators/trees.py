"""Trees over binned columns, grown for many trees at once.

A number is binned at up to a thousand quantiles, a category by its code; a split sends the lower bins of a
number, or one value of a category, to the left. What a split needs are sums per node and bin: class weights
and their squares for forests, first and second derivatives for boosting. Tasks sum them over their rows,
the sums of a node meet in one task, and that task chooses the node's split; the driver sees splits only.
Once a node has few enough rows for a task, its rows meet there and the subtree below it is grown at once.
So small tables take one job for all trees, and large ones a job a level until their nodes are small.

Nodes are numbered as in a heap, from 1; every draw is a hash of seed, tree, node and feature. So results
do not depend on how rows are partitioned, up to the rounding of sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.shared import ship_with_tasks, shuffles_dropped

ship_with_tasks(__name__)

# Rows (of one node of one tree) that a single task may hold.
LOCAL_ROWS = 2_000_000
# Rows that a task looks at together, and below which rows of several nodes are moved on together.
CHUNK_ROWS, FEW_ROWS = 1_000_000, 256
# Rows that a task sums, or sends, at a time: the arrays about them stay in a core's cache.
BLOCK_ROWS = 1 << 15
# Bytes of sums that a task holds before it sends them, and rows that they may stand for.
HELD_BYTES, HELD_ROWS = 1 << 28, 1 << 25
# Bytes of rows that one job sends: the disk that the growing of subtrees takes, whatever the number of trees.
JOB_BYTES = 12 << 30
# Bytes of rows that one task receives, if they are those of several nodes.
TASK_BYTES = 1 << 26
# Nodes of as many rows are split one by one within a task.
MANY_ROWS = 4096
LEAF = -1
# The columns looked at did not hold enough features that can split the node.
UNDECIDED = -2


def scrambled(*parts) -> np.ndarray:
    """64-bit hash of integers or integer arrays."""
    x = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            x = x ^ (np.asarray(part).astype(np.int64).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return np.asarray(x)


@dataclass(frozen=True)
class Growth:
    """How trees grow. Columns with 0 values are numbers, others have that many category values."""

    values: tuple[int, ...]
    depth: int
    seed: int
    # Forests choose splits by Gini impurity, boosting by the second-order gain.
    boosting: bool = False
    least_rows: int = 1
    # Features tried per node, among those that can split it, and the share of features a tree sees.
    per_node: int | None = None
    per_tree: float = 1.0
    step: float = 0.1
    shrink: float = 1.0
    least_weight: float = 1.0

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([v or 1 for v in self.values])])

    def places(self, tree: int, ids: np.ndarray) -> np.ndarray:
        """For each node, the place of each feature in the order in which features are tried."""
        drawn = scrambled(self.seed, 2, tree, ids[:, None], np.arange(self.offsets[-1])[None, :])
        return np.argsort(np.argsort(drawn, axis=1, kind="stable"), axis=1, kind="stable")

    def first_columns(self, tree: int, ids: np.ndarray) -> np.ndarray:
        """Nodes x columns: the columns that are looked at first, since a node's split is likely among them."""
        if self.per_node is None:
            return np.ones((len(ids), len(self.values)), bool)
        # One value of a category can seldom split a node: more features are looked at where there are such.
        first = self.places(tree, ids) < self.per_node * (2 if any(self.values) else 1)
        return np.logical_or.reduceat(first, self.offsets[:-1], axis=1)

    def score(self, sums: np.ndarray) -> np.ndarray:
        if self.boosting:
            return sums[:, 0] ** 2 / (sums[:, 1] + self.shrink)
        weights = sums[:, :-1]
        return (weights**2).sum(axis=1) / np.maximum(weights.sum(axis=1), 1e-300)

    def value(self, sums: np.ndarray) -> np.ndarray:
        """What a leaf says: class shares, or its step."""
        if self.boosting:
            return -self.step * sums[:, :1] / (sums[:, 1:2] + self.shrink)
        weights = np.maximum(sums[:, :-1], 0)
        return weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-300)

    def may_split(self, sums: np.ndarray) -> np.ndarray:
        enough = sums[:, -1] >= 2 * self.least_rows
        if self.boosting:
            return enough & (sums[:, 1] >= 2 * self.least_weight)
        return enough & ((sums[:, :-1] > 0).sum(axis=1) > 1)

    def fits(self, sums: np.ndarray) -> np.ndarray:
        """Whether a child is large enough. Sums of weights carry rounding, counts do not."""
        enough = sums[:, -1] > self.least_rows - 0.5
        return enough & (sums[:, 1] >= self.least_weight) if self.boosting else enough

    def seen(self, tree: int) -> np.ndarray:
        """Features that a tree may use."""
        n = int(self.offsets[-1])
        if self.per_tree >= 1:
            return np.ones(n, bool)
        turn = np.argsort(scrambled(self.seed, 1, tree, np.arange(n)), kind="stable")
        allowed = np.zeros(n, bool)
        allowed[turn[: max(1, int(self.per_tree * n))]] = True
        return allowed


Cells = tuple[np.ndarray, np.ndarray, np.ndarray]


def cells_of(node: np.ndarray, bins: np.ndarray, sums: np.ndarray) -> Cells:
    """Sums per node and bin, by node and bin."""
    if not len(node):
        return node, bins.astype(np.int64), sums
    low, width = node.min(), int(bins.max()) + 1
    cells = (int(node.max() - low) + 1) * width
    key = (node - low) * width + bins
    if cells <= 8 * len(node):
        held = np.flatnonzero(np.bincount(key, minlength=cells))
        added = np.stack([np.bincount(key, sums[:, s], cells)[held] for s in range(sums.shape[1])], axis=1)
        return held // width + low, held % width, added
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[starts] // width + low, key[starts] % width, np.add.reduceat(sums[order], starts, axis=0)


def choose(
    growth: Growth, tree: int, ids: np.ndarray, totals: np.ndarray, columns: list[Cells], known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The best split of each node that has one: row in ``ids``, column, bin; and which nodes are undecided.

    ``known`` tells, per node, the columns whose cells are given (all of them if it is left out). A node is
    undecided if a feature of another column would have to be tried.
    """
    parent = growth.score(totals)
    parts: list[tuple[np.ndarray, ...]] = []
    seen = growth.seen(tree)
    for c, (node, bins, sums) in enumerate(columns):
        first = np.searchsorted(node, np.arange(len(ids)))
        if growth.values[c]:
            left, at, feature = sums, bins, growth.offsets[c] + bins
            able = bins < growth.values[c]
        else:
            upto = np.cumsum(sums, axis=0)
            before = np.vstack([np.zeros((1, sums.shape[1])), upto])[first]
            left = upto - before[node]
            able = np.append(node[1:] == node[:-1], False)[: len(node)]
            # The next bin begins the right side.
            at, feature = np.append(bins[1:], 0)[: len(bins)], np.full(len(bins), growth.offsets[c])
        left, at, feature, node = left[able], at[able], feature[able], node[able]
        right = totals[node] - left
        gain = growth.score(left) + growth.score(right) - parent[node]
        good = growth.fits(left) & growth.fits(right) & (gain > 1e-9 * np.maximum(np.abs(parent[node]), 1e-3))
        good &= seen[np.minimum(feature, growth.offsets[-1] - 1)]
        parts.append((node[good], feature[good], at[good], gain[good], np.full(int(good.sum()), c)))
    node, feature, at, gain, column = (np.concatenate(x) for x in zip(*parts))
    # The best bin of each feature first; ties go to the lower feature and bin.
    order = np.lexsort((at, -gain, feature, node))
    node, feature, at, gain, column = (x[order] for x in (node, feature, at, gain, column))
    best = np.append(True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1]))[: len(node)]
    node, feature, at, gain, column = (x[best] for x in (node, feature, at, gain, column))
    undecided = np.zeros(len(ids), bool)
    if growth.per_node is not None:
        places = growth.places(tree, ids)
        # Features are tried in their order, up to the first of which nothing is known.
        end = np.full(len(ids), places.shape[1])
        if known is not None:
            shown = np.repeat(known, [v or 1 for v in growth.values], axis=1)
            end = np.where(shown, places.shape[1], places).min(axis=1)
        own = places[node, feature]
        reached = own < end[node]
        node, feature, at, gain, column, own = (x[reached] for x in (node, feature, at, gain, column, own))
        turn = np.lexsort((own, node))
        place = np.empty(len(node), np.int64)
        place[turn] = np.arange(len(node)) - np.searchsorted(node, node[turn])
        undecided = (end < places.shape[1]) & (np.bincount(node, minlength=len(ids)) < growth.per_node)
        tried = (place < growth.per_node) & ~undecided[node]
        node, feature, at, gain, column = (x[tried] for x in (node, feature, at, gain, column))
    order = np.lexsort((at, feature, -np.round(gain, 9), node))
    node, at, column = node[order], at[order], column[order]
    top = np.append(True, node[1:] != node[:-1])[: len(node)]
    return node[top], column[top], at[top], undecided


def goes_right(growth: Growth, column: np.ndarray, at: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Side of rows whose nodes split ``column`` at bin ``at``; ``bins`` is rows x columns."""
    own = bins[np.arange(len(bins)), column]
    category = np.array(growth.values)[column] > 0
    return np.where(category, own != at, own >= at)


def sides(growth: Growth, column: int, at: int, bins: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that go left and those that go right at a node, from the bins of its column."""
    own = bins.take(rows)
    right = own != at if growth.values[column] else own >= at
    return rows.take(np.flatnonzero(~right)), rows.take(np.flatnonzero(right))


class Nodes:
    """Nodes of one tree, by number: column (-1 for a leaf), bin, and the leaves' values."""

    def __init__(self, ids: np.ndarray, column: np.ndarray, at: np.ndarray, value: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.column, self.at, self.value = ids[order], column[order], at[order], value[order]
        # One child may be there without the other while a tree grows.
        child = np.stack([2 * self.ids, 2 * self.ids + 1])
        found = np.minimum(np.searchsorted(self.ids, child), max(len(self.ids) - 1, 0))
        self.next = np.where(self.ids[found] == child, found, -child) if len(self.ids) else found

    def open_rows(
        self, growth: Growth, bins: np.ndarray, rows: np.ndarray, few: int = FEW_ROWS
    ) -> Iterator[tuple[int, bool, np.ndarray]]:
        """Where rows end, node by node: position, whether it may lie further down, rows.

        A child that is not there (yet) is given as minus its number. Nodes of fewer than ``few`` rows are
        not followed. ``bins`` should lie column by column.
        """
        stack = [(0 if len(self.ids) else -1, rows)]
        while stack:
            here, rows = stack.pop()
            if not len(rows):
                continue
            if here < 0 or self.column[here] == LEAF:
                yield here, False, rows
            elif len(rows) < few:
                yield here, True, rows
            else:
                column, at = int(self.column[here]), self.at[here]
                left, right = sides(growth, column, at, bins[:, column], rows)
                stack += [(int(self.next[1, here]), right), (int(self.next[0, here]), left)]

    def positions(self, growth: Growth, bins: np.ndarray) -> np.ndarray:
        """Where each row ends; a child that is not there (yet) is given as minus its number."""
        at, rest = np.zeros(len(bins), np.int64), []
        for here, further, rows in self.open_rows(growth, np.asfortranarray(bins), np.arange(len(bins))):
            at[rows] = here
            if further:
                rest.append(rows)
        rows = np.concatenate(rest) if rest else np.zeros(0, np.int64)
        while len(rows):
            here = at[rows]
            right = goes_right(growth, self.column[here], self.at[here], bins[rows])
            then = self.next[right.astype(np.int64), here]
            at[rows] = then
            # Positions below 0 look up the last nodes, and are left out.
            rows = rows[(then >= 0) & (self.column[np.maximum(then, 0)] != LEAF)]
        return at


class _Rows:
    """Rows of one node with their sums.

    Where each row has one class, and weights that are whole multiples of one weight per class, multiples and rows
    are summed as one number per bin and class.
    """

    # Above the rows of a node that is grown in one task.
    SHIFT = float(1 << 24)

    def __init__(self, growth: Growth, bins: np.ndarray, sums: np.ndarray):
        self.bins, self.sums, self.classes = np.asfortranarray(bins), sums, sums.shape[1] - 1
        self.label = None
        if not growth.boosting and len(sums):
            self._pack()
        self.coded: dict[int, np.ndarray] = {}
        # Derivatives are summed one by one; each row counts one.
        self.slopes = [np.ascontiguousarray(x) for x in sums[:, :-1].T] if growth.boosting else None

    @classmethod
    def counted(
        cls, growth: Growth, bins: np.ndarray, label: np.ndarray, times: np.ndarray, rows: np.ndarray, unit: np.ndarray
    ) -> _Rows:
        """Rows of one class each, that count ``times`` its weight in ``unit`` and stand for ``rows``."""
        if rows.sum() >= cls.SHIFT or times.sum() >= 1 << 28:
            return cls(growth, bins, _lines(label, times, rows, unit))
        here = cls.__new__(cls)
        here.bins, here.sums, here.classes, here.coded = bins, None, len(unit), {}
        here.label, here.unit, here.both, here.slopes = label, unit, times * cls.SHIFT + rows, None
        return here

    def _pack(self) -> None:
        weights, rows = self.sums[:, :-1], self.sums[:, -1]
        if (np.count_nonzero(weights, axis=1) > 1).any() or rows.sum() >= self.SHIFT:
            return
        label = weights.argmax(axis=1)
        weight = weights[np.arange(len(weights)), label]
        unit = np.array([np.min(w, initial=np.inf, where=w > 0) for w in weights.T])
        unit[~np.isfinite(unit)] = 1.0
        times = np.rint(weight / unit[label])
        if (np.abs(times * unit[label] - weight) <= 1e-9 * weight).all() and times.sum() < 1 << 28:
            self.label, self.unit, self.both = label, unit, times * self.SHIFT + rows

    def _unpacked(self, found: np.ndarray) -> np.ndarray:
        """Lines of sums from lines of packed sums per class."""
        times = np.floor(found / self.SHIFT)
        return np.column_stack([times * self.unit, (found - times * self.SHIFT).sum(axis=1)])

    def lines(self, rows: np.ndarray) -> np.ndarray:
        """Sums of each row."""
        if self.sums is not None:
            return self.sums[rows]
        times = np.floor(self.both[rows] / self.SHIFT)
        return _lines(self.label[rows], times, self.both[rows] - times * self.SHIFT, self.unit)

    def totals(self, index: np.ndarray, rows: np.ndarray, count: int) -> np.ndarray:
        if self.label is None:
            return np.stack([np.bincount(index, self.sums[rows, s], count) for s in range(self.sums.shape[1])], axis=1)
        key = index * self.classes + self.label[rows]
        return self._unpacked(np.bincount(key, self.both[rows], count * self.classes).reshape(count, -1))

    def cells(self, column: int, node: np.ndarray, rows: np.ndarray) -> Cells:
        own = self.bins[:, column][rows].astype(np.int64)
        if self.label is not None and len(node):
            width, low = int(own.max()) + 1, node.min()
            cells = (int(node.max() - low) + 1) * width
            if cells <= 8 * len(node):
                key = ((node - low) * width + own) * self.classes + self.label[rows]
                return self._counted(key, self.both[rows], cells, width, low)
        return cells_of(node, own, self.lines(rows))

    def told(self, rows: np.ndarray) -> list[np.ndarray] | np.ndarray | None:
        """What rows add to any column's cells."""
        if self.slopes is not None:
            return [x.take(rows) for x in self.slopes]
        return None if self.label is None else self.both.take(rows)

    def cells_of_one(self, column: int, rows: np.ndarray, told: list[np.ndarray] | np.ndarray | None) -> Cells:
        """As above, all rows in node 0."""
        if self.slopes is not None:
            key = self.bins[:, column].take(rows).astype(np.int64)
            n = np.bincount(key)
            held = np.flatnonzero(n)
            sums = np.column_stack([*[np.bincount(key, x)[held] for x in told], n[held]])
            return np.zeros(len(held), np.int64), held, sums
        if told is None:
            own = self.bins[:, column][rows].astype(np.int64)
            return cells_of(np.zeros(len(rows), np.int64), own, self.sums[rows])
        if column not in self.coded:
            code = self.bins[:, column].astype(np.int32) * np.int32(self.classes)
            self.coded[column] = code + self.label.astype(np.int32)
        key = self.coded[column].take(rows)
        cells = int(key.max(initial=0)) // self.classes + 1
        return self._counted(key, told, cells, cells, 0)

    def _counted(self, key: np.ndarray, told: np.ndarray, cells: int, width: int, low: int) -> Cells:
        found = np.bincount(key, told, cells * self.classes).reshape(cells, -1)
        held = np.flatnonzero(found.any(axis=1))
        return held // width + low, held % width, self._unpacked(found[held])


def _lines(label: np.ndarray, times: np.ndarray, rows: np.ndarray, unit: np.ndarray) -> np.ndarray:
    out = np.zeros((len(label), len(unit) + 1))
    out[np.arange(len(label)), label] = times * unit[label]
    out[:, -1] = rows
    return out


def grow(growth: Growth, tree: int, root: int, bins: np.ndarray, sums: np.ndarray) -> list[tuple]:
    """(node, column, bin, value) of the subtree below ``root``, from all its rows.

    Large nodes are split one by one, so that each holds a list of its rows and looks at few columns; the nodes
    below them, which are many, are split level by level, all of a level at once.
    """
    return _grow(growth, tree, root, _Rows(growth, bins, sums))


def _grow(growth: Growth, tree: int, root: int, here: _Rows) -> list[tuple]:
    out: list[tuple] = []
    rest: list[tuple[int, np.ndarray]] = []
    stack = [(root, np.arange(len(here.bins)))] if len(here.bins) else []
    while stack:
        node, rows = stack.pop()
        if len(rows) < MANY_ROWS:
            rest.append((node, rows))
            continue
        column, at, totals = _split_alone(growth, tree, node, here, rows)
        out.append((node, column, at, growth.value(totals)[0].astype(np.float32).tolist() if column == LEAF else None))
        if column != LEAF:
            left, right = sides(growth, column, at, here.bins[:, column], rows)
            stack += [(2 * node + 1, right), (2 * node, left)]
    return out + _grow_levels(growth, tree, here, rest)


def _split_alone(growth: Growth, tree: int, node: int, here: _Rows, rows: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Column and bin of a node's split, LEAF if it has none, and its sums."""
    ids = np.array([node])
    looked = growth.first_columns(tree, ids)
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, here.classes + 1)))
    told = here.told(rows)
    columns = [here.cells_of_one(c, rows, told) if looked[0, c] else none for c in range(len(growth.values))]
    totals = columns[int(looked[0].argmax())][2].sum(axis=0, keepdims=True)
    if int(node).bit_length() - 1 >= growth.depth or not growth.may_split(totals)[0]:
        return LEAF, 0, totals
    where, column, at, undecided = choose(growth, tree, ids, totals, columns, looked)
    if undecided[0]:
        columns = [x if looked[0, c] else here.cells_of_one(c, rows, told) for c, x in enumerate(columns)]
        where, column, at, _ = choose(growth, tree, ids, totals, columns)
    return (int(column[0]), int(at[0]), totals) if len(where) else (LEAF, 0, totals)


def _grow_levels(growth: Growth, tree: int, here: _Rows, nodes: list[tuple[int, np.ndarray]]) -> list[tuple]:
    """The subtrees below some nodes with their rows, all nodes of a level at once."""
    out: list[tuple] = []
    ids = np.array([n for n, _ in nodes], np.int64)
    depth = np.array([int(n).bit_length() - 1 for n, _ in nodes], np.int64)
    index = np.repeat(np.arange(len(nodes)), [len(r) for _, r in nodes])
    rows = np.concatenate([r for _, r in nodes]) if nodes else np.zeros(0, np.int64)
    while len(rows):
        totals = here.totals(index, rows, len(ids))
        column, at = np.full(len(ids), LEAF), np.zeros(len(ids), np.int64)
        waiting = growth.may_split(totals) & (depth < growth.depth)
        known = np.zeros((len(ids), len(growth.values)), bool)
        if waiting.any():
            known[waiting] = growth.first_columns(tree, ids[waiting])
        while waiting.any():
            number = np.cumsum(waiting) - 1
            cells = []
            for c in range(len(growth.values)):
                part = (waiting & known[:, c])[index]
                cells.append(here.cells(c, number[index[part]], rows[part]))
            where, split, place, undecided = choose(growth, tree, ids[waiting], totals[waiting], cells, known[waiting])
            where, left = np.flatnonzero(waiting)[where], np.flatnonzero(waiting)[undecided]
            column[where], at[where] = split, place
            waiting = np.zeros(len(ids), bool)
            waiting[left] = known[left] = True
        values = growth.value(totals).astype(np.float32)
        out += [
            (i, c, a, v if c == LEAF else None)
            for i, c, a, v in zip(ids.tolist(), column.tolist(), at.tolist(), values.tolist())
        ]
        goes_on = column[index] != LEAF
        index, rows = index[goes_on], rows[goes_on]
        if len(rows):
            right = goes_right(growth, column[index], at[index], here.bins[rows])
            child = 2 * index + right
            held = np.bincount(child, minlength=2 * len(ids)) > 0
            index = (np.cumsum(held) - 1)[child]
            ids = np.stack([2 * ids, 2 * ids + 1], axis=1).ravel()[held]
            depth = np.repeat(depth + 1, 2)[held]
    return out


def merged_rows(bins: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, where many are equal: repeated rows cost a tree nothing."""
    key = scrambled(*bins.T)
    # The rows of one part of the hash space tell whether many are equal.
    some = np.sort(key[key < np.uint64(1 << 60)]) if len(key) > 100_000 else np.sort(key)
    if np.count_nonzero(np.diff(some)) > 0.7 * len(some):
        return bins, sums
    order = np.argsort(key, kind="stable")
    ranked = bins[order]
    starts = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)))
    return ranked[starts], np.add.reduceat(sums[order], starts, axis=0)


def merged_words(words: np.ndarray, said: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows of words as one, where many are equal; ``said`` has a line for each number that is added up."""
    key = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) if words.shape[1] == 1 else scrambled(*words.T)
    some = np.sort(key[key < np.uint64(1 << 60)]) if len(key) > 100_000 else np.sort(key)
    if np.count_nonzero(np.diff(some)) > 0.7 * len(some):
        return words, said
    order = np.argsort(key)
    ranked = words[order]
    starts = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)))
    return ranked[starts], np.add.reduceat(said[:, order], starts, axis=1)


class Layout:
    """Small whole numbers of a row, by their bits, side by side in 64-bit words."""

    def __init__(self, bits: Sequence[int]):
        self.bits, self.places, word, used = tuple(bits), [], 0, 0
        for n in self.bits:
            if used + n > 64:
                word, used = word + 1, 0
            self.places.append((word, used))
            used += n
        self.words = word + 1

    def pack(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Rows x words."""
        out = np.zeros((self.words, len(columns[0])), np.uint64)
        for (word, shift), column in zip(self.places, columns):
            out[word] |= column.astype(np.uint64) << np.uint64(shift)
        return np.ascontiguousarray(out.T)

    def column(self, words: np.ndarray, i: int) -> np.ndarray:
        word, shift = self.places[i]
        found = words[:, word] >> np.uint64(shift)
        found &= np.uint64((1 << self.bits[i]) - 1)
        return found


class Block(Protocol):
    """Rows of a table, and what they mean for trees."""

    # Rows x columns, column by column.
    bins: np.ndarray

    def trees(self, wanted: frozenset[int]) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        """For each tree wanted, the rows that it sees, and what there is to say of each row, seen or not."""
        ...

    def codes(self) -> list[np.ndarray]:
        """For each column, the numbers of the cells that the rows are in."""
        ...

    def told(self, said: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """What rows add to the cells of any column."""
        ...

    def fields(self) -> list[np.ndarray]:
        """The columns of a row that is sent: its bins, and what else is the same for all trees."""
        ...

    def beside(self, said: tuple[np.ndarray, ...]) -> np.ndarray:
        """What is sent beside, one line a row."""
        ...


class Source(Protocol):
    """What rows mean for trees."""

    # Bytes of a row's marks.
    beside_bytes: int

    def block(self, batch: pa.RecordBatch) -> Block:
        """Rows that are looked at together."""
        ...

    def packed(self, keys: np.ndarray, told: Sequence[np.ndarray]) -> np.ndarray:
        """What rows add to the cells of one node and column: a line for each number that is summed."""
        ...

    def unpacked(self, tree: int, keys: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins, and the sums of each, of cells sent by several tasks."""
        ...

    def bits(self, most: Sequence[int]) -> list[int]:
        """Bits of the columns that are sent, where ``most`` are the largest bins."""
        ...

    def received(self, growth: Growth, tree: int, layout: Layout, words: np.ndarray, marks: list[tuple[int, bytes]]) -> _Rows:
        """The rows of a node, from the words and marks of all blocks with the number of their rows."""
        ...


SENT = pa.schema(
    [("tree", pa.int32()), ("node", pa.int64()), ("column", pa.int32()), ("bins", pa.binary()), ("sums", pa.binary())]
)
SENT_SQL = "tree int, node long, column int, bins binary, sums binary"
GROWN = pa.schema(
    [("tree", pa.int32()), ("node", pa.int64()), ("column", pa.int32()), ("bin", pa.int32()),
     ("value", pa.list_(pa.float32())), ("left_rows", pa.int64()), ("right_rows", pa.int64())]
)
GROWN_SQL = "tree int, node long, column int, bin int, value array<float>, left_rows long, right_rows long"


def bins_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("bins")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int16)


def chunks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A task's rows, as many at a time as may be looked at together."""
    most = CHUNK_ROWS if most is None else most
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(b.num_rows for b in held) + batch.num_rows > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if batch.num_rows:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_tree(nodes: frozenset[tuple[int, int]]) -> dict[int, tuple[frozenset[int], frozenset[int]]]:
    """For each tree, some of its nodes, and these with all nodes above them."""
    found: dict[int, set[int]] = {}
    for tree, node in nodes:
        found.setdefault(tree, set()).add(node)
    out = {}
    for tree, wanted in found.items():
        above = set(wanted)
        for node in wanted:
            while node > 1:
                node //= 2
                above.add(node)
        out[tree] = frozenset(wanted), frozenset(above)
    return out


def _at_nodes(
    growth: Growth, nodes: Nodes | None, wanted: tuple[frozenset[int], frozenset[int]], columns: list[np.ndarray], rows: np.ndarray
) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each of the wanted open nodes of a tree; other branches are not followed."""
    ends, above = wanted
    if nodes is None:
        yield 1, rows
        return
    stack = [(0, rows)]
    while stack:
        here, rows = stack.pop()
        node, column, at = int(nodes.ids[here]), int(nodes.column[here]), int(nodes.at[here])
        if column == LEAF:
            continue
        own = columns[column].take(rows)
        left = own == at if growth.values[column] else own < at
        for side, child in ((0, 2 * node), (1, 2 * node + 1)):
            if child in above:
                part = rows.take(np.flatnonzero(~left if side else left))
                if not len(part):
                    continue
                if child in ends:
                    yield child, part
                else:
                    stack.append((int(nodes.next[side, here]), part))


def _send_rows(growth: Growth, source: Source, trees: dict[int, Nodes], nodes: frozenset[tuple[int, int]], layout: Layout):
    """All rows of some nodes, packed by node."""
    wanted = _by_tree(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, BLOCK_ROWS):
            block = source.block(batch)
            columns, words = list(block.bins.T), layout.pack(block.fields())
            for tree, rows, said in block.trees(frozenset(wanted)):
                beside = block.beside(said)
                out = [
                    (tree, node, len(own), words.take(own, axis=0).tobytes(), beside.take(own, axis=0).tobytes())
                    for node, own in _at_nodes(growth, trees.get(tree), wanted[tree], columns, rows)
                ]
                if out:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), SENT)], schema=SENT)

    return run


def _finish(growth: Growth, source: Source, layout: Layout):
    """Grow the subtree of one node from all its rows."""

    def run(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        # Blocks arrive in any order; sorted, sums are added up in one order.
        blocks = sorted(zip(*(table.column(c).to_pylist() for c in ("bins", "sums", "column"))))
        words = np.frombuffer(b"".join(b for b, _, _ in blocks), np.uint64).reshape(-1, layout.words)
        here = source.received(growth, tree, layout, words, [(n, s) for _, s, n in blocks])
        out = [(tree, *r, None, None) for r in _grow(growth, tree, root, here)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), GROWN)], schema=GROWN)

    return run


def _send_cells(
    growth: Growth, source: Source, trees: dict[int, Nodes], nodes: frozenset[tuple[int, int]], again: frozenset[tuple[int, int]]
):
    """Sums per node, column and bin of a task's rows, for some large nodes; all columns of those asked again.

    A task adds up the sums of its rows, a block of rows at a time, and sends them tree by tree.
    """
    wanted = _by_tree(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        looked: dict[tuple[int, int], list[int]] = {}
        size = seen = 0
        for batch in chunks(batches, BLOCK_ROWS):
            if size >= HELD_BYTES or seen + batch.num_rows > HELD_ROWS:
                yield from _sent(held)
                held, size, seen = {}, 0, 0
            seen += batch.num_rows
            block = source.block(batch)
            columns, codes = list(block.bins.T), block.codes()
            for tree, rows, said in block.trees(frozenset(wanted)):
                told = block.told(said)
                for node, own in _at_nodes(growth, trees.get(tree), wanted[tree], columns, rows):
                    if (tree, node) not in looked:
                        first = growth.first_columns(tree, np.array([node]))[0] | ((tree, node) in again)
                        looked[tree, node] = np.flatnonzero(first).tolist()
                    part = [t.take(own) for t in told]
                    for c in looked[tree, node]:
                        added = source.packed(codes[c].take(own), part)
                        before = held.get((tree, node, c))
                        if before is None or before.shape[1] < added.shape[1]:
                            before, added = added, before
                            held[tree, node, c] = before
                            size += before.nbytes
                        if added is not None:
                            before[:, : added.shape[1]] += added
        yield from _sent(held)

    return run


def _sent(held: dict[tuple[int, int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    by_tree: dict[int, list[tuple]] = {}
    for (tree, node, c), added in sorted(held.items(), key=lambda item: item[0]):
        keys = np.flatnonzero(added[-1])
        sums = np.ascontiguousarray(added[:, keys].T)
        by_tree.setdefault(tree, []).append((tree, node, c, keys.astype(np.int32).tobytes(), sums.tobytes()))
    for out in by_tree.values():
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), SENT)], schema=SENT)


def _split(growth: Growth, source: Source):
    """Choose the split of one node from all its sums."""

    def run(table: pa.Table) -> pa.Table:
        tree, root = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        blocks = sorted(zip(*(table.column(c).to_pylist() for c in ("column", "bins", "sums"))))
        columns: list[Cells] = []
        for c in range(len(growth.values)):
            keys = np.frombuffer(b"".join(b for k, b, _ in blocks if k == c), np.int32).astype(np.int64)
            added = np.frombuffer(b"".join(s for k, _, s in blocks if k == c)).reshape(len(keys), -1 if len(keys) else 1)
            bins, sums = source.unpacked(tree, keys, added)
            columns.append((np.zeros(len(bins), np.int64), bins, sums))
        known = np.array([[len(bins) > 0 for _, bins, _ in columns]])
        totals = columns[int(known[0].argmax())][2].sum(axis=0, keepdims=True)
        where, undecided = np.zeros(0), np.zeros(1, bool)
        if int(root).bit_length() - 1 < growth.depth and growth.may_split(totals)[0]:
            where, column, at, undecided = choose(growth, tree, np.array([root]), totals, columns, known)
        if undecided[0]:
            row = (tree, root, UNDECIDED, 0, None, None, None)
        elif not len(where):
            row = (tree, root, LEAF, 0, growth.value(totals)[0].tolist(), None, None)
        else:
            _, bins, sums = columns[int(column[0])]
            left = (bins == at[0]) if growth.values[int(column[0])] else bins < at[0]
            low = int(round(sums[left, -1].sum()))
            row = (tree, root, int(column[0]), int(at[0]), None, low, int(round(totals[0, -1])) - low)
        return pa.table([pa.array([v], f.type) for v, f in zip(row, GROWN)], schema=GROWN)

    return run


def grow_trees(
    rows: DataFrame, growth: Growth, source: Source, sizes: dict[int, int], local_rows: int | None = None
) -> list[tuple]:
    """All trees of ``sizes`` (rows per tree): (tree, node, column, bin, value) of every node.

    ``rows`` has ``bins`` and what ``source`` needs; it is read once per level of nodes with more than
    ``local_rows`` rows and once for all that is below.
    """
    limit = LOCAL_ROWS if local_rows is None else local_rows
    found: list[tuple] = []
    small = {(t, 1): n for t, n in sizes.items() if n <= limit}
    large = {(t, 1) for t, n in sizes.items() if n > limit}
    again: set[tuple[int, int]] = set()
    trees: dict[int, Nodes] = {}
    while large:
        sent = rows.mapInArrow(_send_cells(growth, source, trees, frozenset(large), frozenset(again)), SENT_SQL)
        level = sent.groupBy("tree", "node").applyInArrow(_split(growth, source), GROWN_SQL).collect()
        large, again = set(), set()
        for r in level:
            if r["column"] == UNDECIDED:
                large.add((r["tree"], r["node"]))
                again.add((r["tree"], r["node"]))
                continue
            found.append((r["tree"], r["node"], r["column"], r["bin"], r["value"]))
            if r["column"] != LEAF:
                for child, n in ((2 * r["node"], r["left_rows"]), (2 * r["node"] + 1, r["right_rows"])):
                    if n > limit:
                        large.add((r["tree"], child))
                    else:
                        small[r["tree"], child] = n
        trees = nodes_of(found)
    if small:
        layout = Layout(source.bits(largest_bins(rows, len(growth.values))))
        row_bytes = 8 * layout.words + source.beside_bytes
        for nodes in _jobs(small, row_bytes):
            with shuffles_dropped(rows.sparkSession):
                sent = rows.mapInArrow(_send_rows(growth, source, trees, nodes, layout), SENT_SQL)
                # Tasks of few nodes: what they sort fits their memory.
                tasks = max(1, min(len(nodes), sum(small[n] for n in nodes) * row_bytes // TASK_BYTES))
                sent = sent.repartition(max(tasks, 2 * rows.sparkSession.sparkContext.defaultParallelism), "tree", "node")
                below = sent.groupBy("tree", "node").applyInArrow(_finish(growth, source, layout), GROWN_SQL)
                found += [tuple(r)[:5] for r in below.select("tree", "node", "column", "bin", "value").collect()]
    return found


def largest_bins(rows: DataFrame, columns: int) -> list[int]:
    """The largest bin of each column."""
    if not columns:
        return []
    return [n or 0 for n in rows.agg(*[F.max(F.get("bins", F.lit(c))).alias(f"c{c}") for c in range(columns)]).first()]


def _jobs(small: dict[tuple[int, int], int], row_bytes: int) -> Iterator[frozenset[tuple[int, int]]]:
    """Nodes whose rows are sent together, tree by tree."""
    nodes: list[tuple[int, int]] = []
    size = 0
    for tree in sorted({t for t, _ in small}):
        own = {node: n for node, n in small.items() if node[0] == tree}
        if nodes and (size + sum(own.values())) * row_bytes > JOB_BYTES:
            yield frozenset(nodes)
            nodes, size = [], 0
        nodes += own
        size += sum(own.values())
    yield frozenset(nodes)


def nodes_of(found: list[tuple]) -> dict[int, Nodes]:
    by_tree: dict[int, list[tuple]] = {}
    for tree, *row in found:
        by_tree.setdefault(tree, []).append(row)
    trees = {}
    for tree, rows in by_tree.items():
        ids, column, at = (np.array(x, np.int64) for x in list(zip(*rows))[:3])
        width = max((len(r[3]) for r in rows if r[3] is not None), default=1)
        value = np.array([r[3] if r[3] is not None else [0.0] * width for r in rows])
        trees[tree] = Nodes(ids, column, at, value)
    return trees
