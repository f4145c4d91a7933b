"""Bagged forests with weights per bag, and softmax boosting, over binned columns.

Numbers are binned at quantiles that a mergeable sketch gives for all columns in one scan; up to a thousand
distinct values keep a bin each. The edges are stored with the model.

A bag counts each row as often as a Poisson draw says. Row r draws for bag b the b-th number of a Lehmer
generator that starts at the row's digest, so bags do not depend on partitioning and SQL can repeat them.
A bag weighs its classes by its own counts: n / (classes * n_c), over the classes it holds.

Boosting grows one tree per class and round from the softmax's derivatives. Margins are stored every few
rounds; between, tasks add the trees grown since to the stored margins.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.encoding import PREFIX, FeatureSpec, fit_one_hot
from flowlens.operators.shared import hash_key, ship_with_tasks, written_table
from flowlens.operators.stats import quantile_points
from flowlens.operators.trees import (
    BLOCK_ROWS,
    LOCAL_ROWS,
    Growth,
    Layout,
    Nodes,
    _Rows,
    bins_of,
    cells_of,
    chunks,
    grow_trees,
    merged_words,
    nodes_of,
    scrambled,
)

ship_with_tasks(__name__)

BINS = 1024
# Codes of categories are 16-bit numbers.
MOST_VALUES = 32_000
# A Lehmer generator with a prime modulus.
MODULUS, MULTIPLIER = (1 << 31) - 1, 48271
# Above the rows whose sums a task sends together, so that one number can hold rows and draws.
ROWS = 1 << 26
# Bins of a share of a category value.
SHARE_BINS = 128
# Equal rows that are drawn together: their draws and their number fit 16 bits each.
ALIKE_ROWS = 2000
# Nodes of a tree that are split by the sums of all tasks before their rows are sent, which costs more than some
# levels of sums; nodes of few rows are not split so.
NODES_OF_TREE, FEWEST_LOCAL = 32, 250_000
# Marks that every number is compared with.
COMPARED = 6
# Rows that a task scores together.
SCORED_ROWS = 1 << 17
# Rounds whose trees tasks add to the stored margins.
ROUNDS_KEPT = 10


def quantile_edges(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, list[float]]:
    """Per column the distinct values at its ``bins`` - 1 inner quantiles, without the smallest value.

    Bin i holds values from edge i - 1 on and below edge i. With less than ``bins`` distinct values each has a
    bin of its own, so that any two can be told apart; nulls are not counted.
    """
    if not columns:
        return {}
    found = quantile_points(df.select(*columns), [i / bins for i in range(1, bins)], bins)
    edges = {}
    for i, c in enumerate(columns):
        # Where values are few, rare ones lie between the quantiles: they are listed instead.
        values = [] if i not in found else found[i]["marks"] if found[i]["few"] is None else found[i]["few"]
        edges[c] = sorted(set(values) - {found[i]["low"]}) if values else []
    return edges


def fit_bins(prepared: DataFrame, spec: FeatureSpec, bins: int = BINS) -> PipelineModel:
    """The one-hot encoding's stages and one that puts numbers into bins.

    Categories are binned by their codes there, unseen values last. Vectors are made only where they are read.
    """
    stages = list(fit_one_hot(prepared, spec).stages)
    if spec.numbers:
        numbers = [PREFIX + c for c in spec.numbers]
        edges = quantile_edges(prepared, numbers, bins)
        splits = [[-float("inf"), *(edges[c] or [0.0]), float("inf")] for c in numbers]
        outputs = [f"{c}_bin" for c in numbers]
        stages.append(Bucketizer(inputCols=numbers, outputCols=outputs, splitsArray=splits, handleInvalid="keep"))
    return PipelineModel(stages=stages)


def bin_columns(spec: FeatureSpec) -> list[str]:
    return [*[f"{PREFIX}{c}_bin" for c in spec.numbers], *[f"{PREFIX}{c}_index" for c in spec.categories]]


def bin_values(encoder: PipelineModel, spec: FeatureSpec) -> tuple[int, ...]:
    """Number of values of each binned column; 0 for numbers."""
    labels = [len(x) for x in encoder.stages[0].labelsArray] if spec.categories else []
    if max(labels, default=0) > MOST_VALUES:
        raise ValueError(f"a category may have {MOST_VALUES:,} values at most")
    return (*[0] * len(spec.numbers), *labels)


def other_ends(coded: DataFrame, encoder: PipelineModel, spec: FeatureSpec) -> DataFrame:
    """Codes of the categories at the other end of interpolated rows, as ``<code>_nb``."""
    if not spec.categories:
        return coded
    words = [PREFIX + c for c in spec.categories]
    other = encoder.stages[0].copy()
    other.setInputCols([f"{w}_nb" for w in words]).setOutputCols([f"{w}_index_nb" for w in words])
    return other.transform(coded)


def share_bins(encoder: PipelineModel, spec: FeatureSpec) -> Column:
    """Bins of numbers, then for each category value the bin of its share: (1-gap) at one end, gap at the other.

    No share has the first bin and a whole one the last, which no share between them has.
    """
    parts = [F.array(*[F.col(f"{PREFIX}{c}_bin").cast("smallint") for c in spec.numbers]).cast("array<smallint>")]
    values = bin_values(encoder, spec)[len(spec.numbers) :]
    parts += [_bins_of_shares(f"{PREFIX}{c}_index", n) for c, n in zip(spec.categories, values) if n]
    return F.concat(*parts)


def _bins_of_shares(code: str, values: int) -> Column:
    one, other, gap = F.col(code), F.col(f"{code}_nb"), F.col("gap")
    between = F.least(F.floor(gap * (SHARE_BINS - 2)), F.lit(SHARE_BINS - 3))

    def bin_of(value: Column) -> Column:
        at_one = F.when((other == value) | (gap == 0), SHARE_BINS - 1).otherwise(SHARE_BINS - 2 - between)
        at_other = F.when(gap == 0, 0).otherwise(1 + between)
        return F.when(one == value, at_one).when(other == value, at_other).otherwise(0).cast("smallint")

    return F.transform(F.sequence(F.lit(0), F.lit(values - 1)), bin_of)


def _whole_shares(bins: np.ndarray, numbers: int, values: list[int]) -> np.ndarray:
    """The same columns for rows that were not interpolated, from the codes of their categories."""
    shares = [(bins[:, numbers + i, None] == np.arange(n)) * (SHARE_BINS - 1) for i, n in enumerate(values)]
    return np.hstack([bins[:, :numbers], *shares]).astype(np.int16)


def bag_key(seed: int | str, *parts: Column | str) -> Column:
    """Where a row's generator starts: 1 to MODULUS - 1."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 15), 16, 10).cast("bigint") % (MODULUS - 1) + 1


def poisson_marks() -> list[int]:
    """Draws from the i-th mark on count at least i + 1: the Poisson distribution of mean one, times MODULUS."""
    marks, total, term = [], 0.0, float(np.exp(-1.0))
    for i in range(1, 13):
        total += term
        term /= i
        marks.append(int(total * MODULUS))
    return marks


def multipliers(bags: int) -> np.ndarray:
    out, x = [], 1
    for _ in range(bags):
        x = x * MULTIPLIER % MODULUS
        out.append(x)
    return np.array(out, np.int64)


class Bags:
    """Poisson draws of rows for a number of bags, and the class weights of each bag.

    What is said of a row: its class, how often it was drawn, and the rows it stands for.
    """

    beside_bytes = 1

    def __init__(self, bags: int, classes: int, weights: np.ndarray | None = None, counted: bool = True):
        self.factors, self.marks, self.classes = multipliers(bags), np.array(poisson_marks(), np.uint32), classes
        self.weights, self.counted = weights, counted

    def draws(self, keys: np.ndarray) -> np.ndarray:
        """How often each row is in each bag."""
        if not self.counted:
            return np.ones((len(keys), len(self.factors)), np.int64)
        return np.searchsorted(self.marks, keys[:, None] * self.factors % MODULUS, side="right")

    def drawn(self, keys: np.ndarray, bag: int) -> np.ndarray:
        """How often each row is in one bag."""
        if not self.counted:
            return np.ones(len(keys), np.int8)
        at = _modulo(keys * self.factors[bag])
        # Comparisons take less time than a search; few rows are drawn more often than they tell.
        out = (at >= self.marks[0]).astype(np.int8)
        for mark in self.marks[1:COMPARED]:
            out += at >= mark
        often = np.flatnonzero(out == COMPARED)
        out[often] = np.searchsorted(self.marks, at[often], side="right")
        return out

    def block(self, batch: pa.RecordBatch) -> DrawnRows:
        return DrawnRows(self, batch)

    def rows(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each bag the rows drawn, of equal ones that follow each other the first, and what is said of them."""
        block = self.block(batch)
        for bag, rows, (draws, counts) in block.trees(frozenset(range(len(self.factors)))):
            said = [block.label[rows], draws[rows], (draws != 0)[rows] if counts is None else counts[rows]]
            yield bag, rows if block.starts is None else block.starts[rows], np.stack(said, axis=1).astype(np.int16)

    def sums(self, tree: int, said: np.ndarray) -> np.ndarray:
        label, n = said[:, 0].astype(np.int64), said[:, 1]
        out = np.zeros((len(said), self.classes + 1))
        out[np.arange(len(said)), label] = n * (1.0 if self.weights is None else self.weights[tree, label])
        out[:, -1] = said[:, 2] if said.shape[1] > 2 else 1
        return out

    def packed(self, keys: np.ndarray, told: Sequence[np.ndarray]) -> np.ndarray:
        return np.bincount(keys, told[0])[None, :]

    def unpacked(self, tree: int, keys: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, rows = np.divmod(added[:, 0], ROWS)
        cells = (int(keys.max(initial=-1)) // self.classes + 1) * self.classes
        n, rows = (np.bincount(keys, x, cells).reshape(-1, self.classes) for x in (n, rows))
        bins = np.flatnonzero(rows.sum(axis=1))
        # Weights come last: counts add up alike in any order.
        n = n[bins] * (1.0 if self.weights is None else self.weights[tree])
        return bins, np.column_stack([n, rows[bins].sum(axis=1)])

    def bits(self, most: Sequence[int]) -> list[int]:
        return [int(n).bit_length() for n in (*most, self.classes - 1)]

    def received(self, growth: Growth, tree: int, layout: Layout, words: np.ndarray, marks: list[tuple[int, bytes]]) -> _Rows:
        said = np.ones((2, len(words)), np.int64)
        start = 0
        for n, sent in marks:
            if len(sent) == n:
                said[0, start : start + n] = np.frombuffer(sent, np.uint8)
            else:
                said[:, start : start + n] = np.frombuffer(sent, np.uint16).reshape(n, 2).T
            start += n
        words, (draws, rows) = merged_words(words, said)
        columns = len(layout.bits) - 1
        bins = np.empty((len(words), columns), np.int16, order="F")
        for c in range(columns):
            bins[:, c] = layout.column(words, c)
        label = layout.column(words, columns).astype(np.int64)
        unit = np.ones(self.classes) if self.weights is None else self.weights[tree]
        return _Rows.counted(growth, bins, label, draws, rows, unit)


def _modulo(x: np.ndarray) -> np.ndarray:
    """Products of two numbers from 1 to MODULUS - 1, modulo MODULUS; changes ``x``."""
    # A multiple of MODULUS + 1 counts 1.
    high = x >> 31
    x &= MODULUS
    x += high
    found = x.astype(np.uint32)
    # What is below MODULUS becomes very large when it is taken off.
    return np.minimum(found, found - np.uint32(MODULUS))


class DrawnRows:
    """Rows of a forest's table, those that are equal and follow each other as one; said of a row are its draws, and
    how many rows it stands for (None for one each)."""

    def __init__(self, source: Bags, batch: pa.RecordBatch):
        self.source, self.keys = source, batch.column("key").to_numpy()
        label, bins = batch.column("label").to_numpy().astype(np.int64), bins_of(batch)
        starts = _runs(label, *bins.T)
        self.starts = None
        if len(starts) <= 0.7 * len(label):
            # In blocks of bounded size.
            run = np.repeat(starts, np.diff(np.append(starts, len(label))))
            self.starts = np.flatnonzero((np.arange(len(label)) - run) % ALIKE_ROWS == 0)
            label, bins = label[self.starts], bins[self.starts]
        self.label, self.bins = label, np.asfortranarray(bins)

    def trees(self, wanted: frozenset[int]) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        counts = _counts_of_draws(1 << 16, np.int32)
        for bag in sorted(wanted):
            draws = self.source.drawn(self.keys, bag)
            if self.starts is None:
                yield bag, np.flatnonzero(draws != 0), (draws, None)
            else:
                both = np.add.reduceat(counts[draws], self.starts)
                yield bag, np.flatnonzero(both), (both >> 16, both & 0xFFFF)

    def codes(self) -> list[np.ndarray]:
        return [column.astype(np.int64) * self.source.classes + self.label for column in self.bins.T]

    def told(self, said: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """Draws and rows in one number: fewer than ``ROWS`` rows are sent at once."""
        draws, counts = said
        return [draws * float(ROWS) + (draws != 0 if counts is None else counts)]

    def fields(self) -> list[np.ndarray]:
        return [*self.bins.T, self.label]

    def beside(self, said: tuple[np.ndarray, ...]) -> np.ndarray:
        draws, counts = said
        return draws.astype(np.uint8) if counts is None else np.stack([draws, counts], axis=1).astype(np.uint16)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    differs = np.ones(len(columns[0]), bool)
    differs[1:] = False
    for column in columns:
        differs[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(differs)


def _counts_of_draws(one: int, dtype: type) -> np.ndarray:
    """By the draws of a row: the draws, times ``one``, plus one for a row that was drawn."""
    n = np.arange(len(poisson_marks()) + 1)
    return (n * one + (n > 0)).astype(dtype)


def _count_bags(source: Bags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags = len(source.factors)
        most = len(poisson_marks()) + 1
        found = np.zeros((bags, source.classes * most), np.int64)
        for batch in chunks(batches, BLOCK_ROWS):
            label = batch.column("label").to_numpy().astype(np.int64) * most
            keys = batch.column("key").to_numpy()
            for bag in range(bags):
                found[bag] += np.bincount(label + source.drawn(keys, bag), minlength=source.classes * most)
        by_draws = found.reshape(bags, source.classes, most)
        counts = np.stack([by_draws @ np.arange(most), by_draws[..., 1:].sum(axis=2)], axis=2)
        bag, label = np.divmod(np.arange(bags * source.classes), source.classes)
        yield pa.record_batch(
            [pa.array(bag.astype(np.int32)), pa.array(label.astype(np.int32)), pa.array(counts[..., 0].ravel()),
             pa.array(counts[..., 1].ravel())],
            ["bag", "label", "n", "n_rows"],
        )

    return run


def bag_class_counts(rows: DataFrame, bags: int, classes: int, counted: bool = True) -> DataFrame:
    """Per bag and class (of ``key`` and ``label``): draws ``n``, and how many rows were drawn."""
    counts = rows.select("key", "label").mapInArrow(
        _count_bags(Bags(bags, classes, counted=counted)), "bag int, label int, n long, n_rows long"
    )
    return counts.groupBy("bag", "label").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def bag_weights(counts: DataFrame) -> DataFrame:
    """Balanced weight of each class within each bag, from that bag's draws alone."""
    of_bag = counts.where("n > 0").groupBy("bag").agg(F.sum("n").alias("__all"), F.count("*").alias("__classes"))
    weight = F.when(F.col("n") > 0, F.col("__all") / (F.col("__classes") * F.col("n"))).otherwise(0.0)
    return counts.join(of_bag, "bag").select("bag", "label", "n", "n_rows", weight.alias("weight"))


def fit_forest(
    rows: DataFrame,
    growth: Growth,
    classes: int,
    trees: int,
    balanced: str | None = "per_bag",
    bootstrap: bool = True,
    local_rows: int | None = None,
) -> list[tuple]:
    """Trees of a bagged forest from ``key``, ``label`` and ``bins``.

    ``balanced`` weighs classes "per_bag", by the counts of all rows ("all"), or not at all (None).
    """
    weights = np.ones((trees, classes))
    sizes = dict.fromkeys(range(trees), 0)
    drawn = np.zeros((trees, classes))
    # A row per bag and class comes to the driver, so rows are drawn once to count them.
    for r in bag_class_counts(rows, trees, classes, bootstrap).collect():
        sizes[r["bag"]] += r["n_rows"]
        drawn[r["bag"], r["label"]] = r["n"]
    if balanced == "per_bag":
        held = (drawn > 0).sum(axis=1, keepdims=True)
        weights = np.where(drawn > 0, drawn.sum(axis=1, keepdims=True) / np.maximum(held * drawn, 1), 0.0)
    if balanced == "all":
        n = np.zeros(classes)
        for r in bag_class_counts(rows, 1, classes, False).collect():
            n[r["label"]] = r["n"]
        weights[:] = n.sum() / np.maximum((n > 0).sum() * n, 1)
    source = Bags(trees, classes, weights, bootstrap)
    if local_rows is None:
        local_rows = min(LOCAL_ROWS, max(FEWEST_LOCAL, max(sizes.values()) // NODES_OF_TREE))
    return grow_trees(rows, growth, source, {t: n for t, n in sizes.items() if n}, local_rows)


class Rounds:
    """Derivatives of the softmax at the margins that stored margins and some later trees give."""

    beside_bytes = 16

    def __init__(self, growth: Growth, classes: int, since: list[dict[int, Nodes]], number: int, share: float):
        self.growth, self.classes, self.since, self.number, self.share = growth, classes, since, number, share

    def margins(self, batch: pa.RecordBatch, bins: np.ndarray) -> np.ndarray:
        stored = batch.column("margins").flatten().to_numpy(zero_copy_only=False)
        margins = stored.reshape(batch.num_rows, self.classes).astype(np.float64)
        for trees in self.since:
            for tree, nodes in trees.items():
                margins[:, tree % self.classes] += nodes.value[nodes.positions(self.growth, bins), 0]
        return margins

    def block(self, batch: pa.RecordBatch) -> SlopedRows:
        return SlopedRows(self, batch)

    def packed(self, keys: np.ndarray, told: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount(keys, told[0]), np.bincount(keys, told[1]), np.bincount(keys)])

    def unpacked(self, tree: int, keys: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, bins, sums = cells_of(np.zeros(len(keys), np.int64), keys, added)
        return bins, sums

    def bits(self, most: Sequence[int]) -> list[int]:
        return [int(n).bit_length() for n in most]

    def received(self, growth: Growth, tree: int, layout: Layout, words: np.ndarray, marks: list[tuple[int, bytes]]) -> _Rows:
        said = np.frombuffer(b"".join(s for _, s in marks)).reshape(len(words), 2)
        bins = np.empty((len(words), len(layout.bits)), np.int16, order="F")
        for c in range(len(layout.bits)):
            bins[:, c] = layout.column(words, c)
        return _Rows(growth, bins, np.hstack([said, np.ones((len(said), 1))]))

    def advance(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            if batch.num_rows:
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * self.classes)
                margins = pa.ListArray.from_arrays(ends, pa.array(self.margins(batch, np.asfortranarray(bins_of(batch))).ravel()))
                yield batch.set_column(batch.schema.get_field_index("margins"), "margins", margins)


class SlopedRows:
    """Rows of a table with margins; said of a row are the first and second derivative."""

    def __init__(self, source: Rounds, batch: pa.RecordBatch):
        self.source, self.bins = source, np.asfortranarray(bins_of(batch))
        self.shares = _softmax(source.margins(batch, self.bins))
        self.label = batch.column("label").to_numpy()
        drawn = scrambled(source.growth.seed, 3, source.number, batch.column("key").to_numpy()) / 2.0**64 < source.share
        self.rows = np.flatnonzero(drawn)

    def trees(self, wanted: frozenset[int]) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        first = self.source.number * self.source.classes
        for c in range(self.source.classes):
            if first + c in wanted:
                p = self.shares[:, c]
                yield first + c, self.rows, (p - (self.label == c), np.maximum(2 * p * (1 - p), 1e-16))

    def codes(self) -> list[np.ndarray]:
        return [column.astype(np.int64) for column in self.bins.T]

    def told(self, said: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        return list(said)

    def fields(self) -> list[np.ndarray]:
        return list(self.bins.T)

    def beside(self, said: tuple[np.ndarray, ...]) -> np.ndarray:
        return np.stack(said, axis=1)


def _softmax(margins: np.ndarray) -> np.ndarray:
    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def fit_boosted(
    rows: DataFrame, growth: Growth, classes: int, rounds: int, share: float = 1.0, local_rows: int | None = None
) -> list[tuple]:
    """Trees of softmax boosting from ``key``, ``label`` and ``bins``: tree round * classes + class."""
    growth = replace(growth, boosting=True)
    zeros = F.array(*[F.lit(0.0)] * classes).alias("margins")
    state = written_table(rows.select("key", "label", "bins", zeros), "boosting")
    n = state.count()
    schema = "key long, label int, bins array<smallint>, margins array<double>"
    found: list[tuple] = []
    since: list[dict[int, Nodes]] = []
    for number in range(rounds if n else 0):
        if len(since) == ROUNDS_KEPT:
            state = written_table(state.mapInArrow(Rounds(growth, classes, since, number, share).advance, schema), "boosting")
            since = []
        sizes = dict.fromkeys(range(number * classes, (number + 1) * classes), n)
        grown = grow_trees(state, growth, Rounds(growth, classes, since, number, share), sizes, local_rows)
        found += grown
        since.append(nodes_of(grown))
    return found


class TreeModel:
    """A stored ensemble: bins, trees, classes. Scores in Arrow batches; one task holds all trees, not all rows."""

    def __init__(self, encoder: PipelineModel, spec: FeatureSpec, growth: Growth, classes: list[str], found: list[tuple], output: str, shares: bool = False):
        self.encoder, self.spec, self.growth, self.classes, self.found, self.output = encoder, spec, growth, classes, found, output
        # Whether each category value is a column of its own, which holds its share.
        self.shares = shares

    @property
    def stages(self) -> list:
        return self.encoder.stages

    def transform(self, prepared: DataFrame) -> DataFrame:
        """Adds ``probability`` per class (in their order) and the predicted class."""
        binned = self.encoder.transform(prepared)
        numbers = len(self.spec.numbers)
        values = list(bin_values(self.encoder, self.spec)[numbers:]) if self.shares else None
        score = _scorer(self.growth, nodes_of(self.found), len(self.classes), numbers, values)
        binned = binned.withColumn("probability", score(*[F.col(c).cast("int") for c in bin_columns(self.spec)]))
        best = F.array_position("probability", F.array_max("probability"))
        names = F.array(*[F.lit(c) for c in self.classes])
        return binned.withColumn(self.output, F.element_at(names, best.cast("int")))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.encoder.write().overwrite().save(f"{path}/encoder")
        nodes = spark.createDataFrame(self.found, "tree int, node long, column int, bin int, value array<float>")
        nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        facts = {"spec": asdict(self.spec), "growth": asdict(self.growth), "classes": self.classes, "output": self.output, "shares": self.shares}
        spark.createDataFrame([(json.dumps(facts),)], "value string").write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        facts = json.loads(spark.read.text(f"{path}/facts").where("value <> ''").first()["value"])
        spec = FeatureSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts["spec"].items()})
        growth = Growth(**{k: tuple(v) if isinstance(v, list) else v for k, v in facts["growth"].items()})
        found = [tuple(r) for r in spark.read.parquet(f"{path}/nodes").collect()]
        return cls(PipelineModel.load(f"{path}/encoder"), spec, growth, facts["classes"], found, facts["output"], facts.get("shares", False))


def _scorer(growth: Growth, trees: dict[int, Nodes], classes: int, numbers: int, values: list[int] | None):
    def shares_of(held: list[tuple[pa.Array, ...]]) -> pa.Array:
        columns = [np.concatenate([c.to_numpy(zero_copy_only=False) for c in cs]) for cs in zip(*held)]
        bins = np.stack(columns, axis=1).astype(np.int16)
        bins = np.asfortranarray(bins if values is None else _whole_shares(bins, numbers, values))
        total = np.zeros((len(bins), classes))
        for tree, nodes in trees.items():
            value = nodes.value[nodes.positions(growth, bins)]
            if growth.boosting:
                total[:, tree % classes] += value[:, 0]
            else:
                total += value
        shares = _softmax(total) if growth.boosting else total / max(len(trees), 1)
        ends = pa.array(np.arange(len(bins) + 1, dtype=np.int32) * classes)
        return pa.ListArray.from_arrays(ends, pa.array(shares.ravel()))

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        # Trees are walked node by node: the more rows at once, the fewer steps per row.
        held: list[tuple[pa.Array, ...]] = []
        for batch in batches:
            held.append(batch)
            if sum(len(columns[0]) for columns in held) >= SCORED_ROWS:
                yield shares_of(held)
                held = []
        if held:
            yield shares_of(held)

    return score
