"""Spark ML's multilayer perceptron, trained by passes over Arrow batches.

Start, loss and solver are Spark ML's: L-BFGS from the seed's weights over the mean cross entropy of all rows, with
its line search and its tests of convergence, and the result is its model. Tasks work out loss and slope of a
thousand rows at a time in matrices, the driver adds up one slope per task.

Rows are worked out in single precision and summed in double. Where a line search fails, because what is left to gain
is below that precision, the solver goes on in double.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from flowlens.operators.shared import ship_with_tasks, spread

ship_with_tasks(__name__)

# Rows that are multiplied together: their outputs of all layers stay in a core's cache.
BLOCK = 1024
# What a block holds.
PACKED = {"label": np.int32, "numbers": np.float64, "codes": np.int32}
# What Spark ML's solver works with: pairs of steps kept, values looked back on, tries per line search, Wolfe's limits.
CORRECTIONS, LOOKED_BACK, TRIES, DECREASE, CURVATURE = 10, 20, 10, 1e-4, 0.9

Cost = Callable[[np.ndarray, type], tuple[float, np.ndarray]]


def by_layer(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of each layer's matrix (inputs, outputs) and its bias, in Spark ML's order."""
    found, at = [], 0
    for inputs, outputs in zip(layers, layers[1:]):
        end = at + inputs * outputs
        found.append((weights[at:end].reshape(inputs, outputs), weights[end : end + outputs]))
        at = end + outputs
    return found


def packed(numbers: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, each column's values side by side: every pass reads them, so no pass has to convert rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            label, *rest = [c.to_numpy() for c in batch.slice(at, BLOCK).columns]
            parts = (label, *[np.array(x, t) for x, t in ((rest[:numbers], np.float64), (rest[numbers:], np.int32))])
            yield pa.record_batch({name: [x.tobytes()] for name, x in zip(PACKED, parts)})


class Slope:
    """Number, loss and slope of a task's blocks.

    A code stands for as many inputs as its category has values; codes beyond them are all zeros.
    """

    def __init__(self, layers: Sequence[int], numbers: int, values: Sequence[int], weights: np.ndarray, kind: type):
        self.layers, self.numbers, self.values, self.weights, self.kind = layers, numbers, values, weights, kind

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = by_layer(self.weights.astype(self.kind), self.layers)
        self.back = [w for w, _ in parts]
        # Hidden layers take the sigmoid, which begins with the exponential of the negative.
        signs = [*[-1] * (len(parts) - 1), 1]
        self.forth = [(np.ascontiguousarray(s * w.T), (s * b)[:, None]) for s, (w, b) in zip(signs, parts)]
        # One column per row. Held for all blocks: new ones would cost as much as the work on them.
        self.outputs = [np.empty((n, BLOCK), self.kind) for n in self.layers]
        self.slopes = [np.empty((n, BLOCK), self.kind) for n in self.layers]
        total = np.zeros(len(self.weights))
        n, loss, sums = 0, 0.0, by_layer(total, self.layers)
        with np.errstate(over="ignore"):
            for batch in batches:
                for block in zip(*batch.columns):
                    label, told, codes = (np.frombuffer(x.as_buffer(), t) for x, t in zip(block, PACKED.values()))
                    n += len(label)
                    loss += self.add(label, told, codes, sums)
        if n:
            yield pa.record_batch({"n": [n], "loss": [loss], "slope": [total.tobytes()]})

    def add(self, label: np.ndarray, told: np.ndarray, codes: np.ndarray, sums: list[tuple[np.ndarray, np.ndarray]]) -> float:
        rows, last = np.arange(len(label)), len(self.forth)
        held = [x[:, : len(rows)] for x in self.outputs]
        self.fill(told.reshape(self.numbers, len(rows)), codes.reshape(len(self.values), len(rows)), held[0])
        for i, (weight, bias) in enumerate(self.forth, 1):
            out = np.matmul(weight, held[i - 1], out=held[i])
            out += bias
            if i < last:
                np.exp(out, out=out)
                out += 1
                np.reciprocal(out, out=out)
        margins = held[last].astype(np.float64)
        margins -= margins.max(axis=0)
        own = margins[label, rows]
        np.exp(margins, out=margins)
        mass = margins.sum(axis=0)
        margins /= mass
        margins[label, rows] -= 1
        slope = margins.astype(self.kind)
        for i in range(last - 1, -1, -1):
            sums[i][0][:] += held[i] @ slope.T
            sums[i][1][:] += slope.sum(axis=1)
            if i:
                slope = np.matmul(self.back[i], slope, out=self.slopes[i][:, : len(rows)])
                slope *= held[i]
                np.subtract(1, held[i], out=held[i])
                slope *= held[i]
        return float((np.log(mass) - own).sum())

    def fill(self, told: np.ndarray, codes: np.ndarray, inputs: np.ndarray) -> None:
        inputs[: self.numbers] = told
        inputs[self.numbers :] = 0
        low = self.numbers
        for code, values in zip(codes, self.values):
            known = np.flatnonzero(code < values)
            inputs[low + code[known], known] = 1
            low += values


def fit_perceptron(
    classifier: MultilayerPerceptronClassifier, rows: DataFrame, numbers: Sequence[str], codes: Sequence[str], values: Sequence[int]
) -> MultilayerPerceptronClassificationModel:
    """The classifier's model over ``numbers`` and ``codes``, whose categories have so many ``values``, and its label."""
    layers, iterations = classifier.getLayers(), classifier.getMaxIter()
    # Without iterations Spark ML only says its starting weights, and makes a model of given ones.
    origin = rows.sparkSession.createDataFrame(
        [(Vectors.dense([0.0] * layers[0]), 0.0)], [classifier.getFeaturesCol(), classifier.getLabelCol()]
    )
    idle = classifier.copy({classifier.maxIter: 0})
    start = idle.fit(origin).weights.toArray()
    columns = [rows[classifier.getLabelCol()].cast("int").alias("label"), *[rows[c].cast("double") for c in numbers]]
    dealt = spread(rows.select(*columns, *[rows[c].cast("int") for c in codes]))
    blocks = dealt.mapInArrow(partial(packed, len(numbers)), ", ".join(f"{c} binary" for c in PACKED))
    blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)

    def cost(weights: np.ndarray, kind: type) -> tuple[float, np.ndarray]:
        told = blocks.mapInArrow(Slope(layers, len(numbers), values, weights, kind), "n long, loss double, slope binary").collect()
        n = sum(r["n"] for r in told)
        return sum(r["loss"] for r in told) / n, sum(np.frombuffer(r["slope"]) for r in told) / n

    try:
        found = minimise(cost, start, iterations, classifier.getTol())
    finally:
        blocks.unpersist()
    model = idle.copy({idle.initialWeights: Vectors.dense(found)}).fit(origin)
    model.set(model.maxIter, iterations)
    return model


def minimise(cost: Cost, start: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """L-BFGS over ``cost``, which gives value and slope of weights in a precision."""
    weights, kind, failed = start, np.float32, False
    value, slope = cost(weights, kind)
    first, past, pairs = value, deque([np.inf], LOOKED_BACK), deque(maxlen=CORRECTIONS)
    done = 0
    while done < iterations:
        if np.linalg.norm(slope) <= max(tolerance * value, 1e-8):
            break
        if len(past) > 1 and abs(value - max(past)) <= tolerance * first:
            break
        way = -_direction(pairs, slope)
        step = 1.0 if done else 1 / np.linalg.norm(way)
        found = _search(lambda t: cost(weights + t * way, kind), value, slope, way, step)
        if found is None:
            if failed:
                break
            failed, kind = True, np.float64
            pairs.clear()
            value, slope = cost(weights, kind)
            continue
        step, value, risen = found
        pairs.append((step * way, risen - slope))
        weights, slope, failed = weights + step * way, risen, False
        past.append(value)
        done += 1
    return weights


def _direction(pairs: Sequence[tuple[np.ndarray, np.ndarray]], slope: np.ndarray) -> np.ndarray:
    """The slope times the inverse curvature that the last steps tell."""
    way, shares = slope.copy(), []
    for moved, risen in reversed(pairs):
        shares.append(moved @ way / (moved @ risen))
        way -= shares[-1] * risen
    if pairs:
        moved, risen = pairs[-1]
        way *= moved @ risen / (risen @ risen)
    for moved, risen in pairs:
        way += moved * (shares.pop() - risen @ way / (moved @ risen))
    return way


def _search(
    cost: Callable[[float], tuple[float, np.ndarray]], value: float, slope: np.ndarray, way: np.ndarray, step: float
) -> tuple[float, float, np.ndarray] | None:
    """A step along ``way`` that meets the strong Wolfe conditions, with its value and slope; None where none is found."""
    fall = slope @ way
    if not fall < 0:
        return None
    # Ends of the bracket: step, value, rise along the way, slope. After the first end is found it is halved by cubics.
    low, high = (0.0, value, fall, slope), None
    for number in range(TRIES):
        at = _try(cost, step, way)
        if not np.isfinite(at[1]):
            step /= 2
            continue
        if at[1] > value + DECREASE * step * fall or (number and at[1] >= low[1]):
            high = at
            break
        if abs(at[2]) <= CURVATURE * abs(fall):
            return at[0], at[1], at[3]
        if at[2] >= 0:
            low, high = at, low
            break
        low, step = at, step * 1.5
    for _ in range(TRIES if high else 0):
        at = _try(cost, _between(*sorted((low, high), key=lambda end: end[0])), way)
        if at[1] > value + DECREASE * at[0] * fall or at[1] >= low[1]:
            high = at
            continue
        if abs(at[2]) <= CURVATURE * abs(fall):
            return at[0], at[1], at[3]
        if at[2] * (high[0] - low[0]) >= 0:
            high = low
        low = at
    return None


def _try(cost: Callable[[float], tuple[float, np.ndarray]], step: float, way: np.ndarray) -> tuple[float, float, float, np.ndarray]:
    value, slope = cost(step)
    return step, value, slope @ way, slope


def _between(left: tuple, right: tuple) -> float:
    """Where the cubic through both ends is lowest, kept off the ends."""
    (a, low, fall, _), (b, high, rise, _) = left, right
    mid = fall + rise - 3 * (low - high) / (a - b)
    root = np.sqrt(max(mid * mid - fall * rise, 0.0))
    bend = rise - fall + 2 * root
    best = b - (b - a) * (rise + root - mid) / bend if bend else (a + b) / 2
    return float(np.clip(best, a + 0.1 * (b - a), a + 0.9 * (b - a)))
