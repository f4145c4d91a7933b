"""Counts, distributions, medians and modes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric
from flowlens.operators.shared import collect_lookup, join_lookup, ship_with_tasks, written_table
from flowlens.operators.trees import chunks

ship_with_tasks(__name__)

# Buckets per power of two in the first median pass, and per value range in the second.
_PER_OCTAVE = 256
_PER_RANGE = 4096
# Rows of a range whose values may be counted one by one.
_RANGE_ROWS = 100_000
# The quantile sketch's ranks are off by one in so many rows at most.
_SKETCHED = 100_000
# Points that the values of a block of rows, or of many blocks, are reduced to; by how many ranks they are off, as a
# share of the rows; and parts in which they are reduced.
_POINTS, _POINTS_ERROR, _POINT_PARTS = 1 << 18, 5e-6, 32


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("records"))


def class_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per class and key; missing classes are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(*by, F.col(column).alias("class"))
        .agg(F.count("*").alias("n"))
    )


def chart_frame(counts: DataFrame) -> DataFrame:
    return counts.orderBy(F.desc("n"), F.asc("class"))


def shares(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Turn (by..., class, n) into (by..., class, share). The window sees one row per key and class."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return counts.select(*by, "class", (F.col("n") / total).alias("share"))


def class_distribution(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    return shares(class_counts(df, column, by), by)


def distinct_classes(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("class")).where("class is not null").distinct().orderBy("class")


def column_medians(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), approx: bool = False
) -> DataFrame:
    """Medians as rows (by..., column, median), the middle two values averaged.

    ``F.median`` would gather a histogram of every distinct value in one task. Here a first scan counts each
    column's values and brackets its middle ranks by a mergeable quantile sketch; a second one counts what
    lies below the bracket and each value inside, a few of 100,000 rows. So two scans give exact medians. Where
    that is still too much for a task (some billions of values of one key), or the sketch's bracket should not
    hold, value ranges are counted in further passes instead. ``df`` should be a stored table.

    ``approx`` stops after the first scan: a value whose rank is off by one in 100,000 rows at most.
    """
    by = list(by)
    keys = [*by, "column"]
    types = dict(df.dtypes)
    pairs = [
        F.struct(F.lit(c).alias("column"), numeric.as_number(F.col(c), types[c]).alias("value"))
        for c in columns
    ]
    values = df.select(*by, F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    if approx:
        middle = F.percentile_approx("value", 0.5, F.lit(_SKETCHED)).alias("median")
        return values.groupBy(*keys).agg(middle)
    state, rows = _kept(_brackets(values, keys), "brackets")
    largest = state.agg(F.max("n")).first()[0] if rows is None else max((r["n"] for r in rows), default=0)
    if (largest or 0) * 4 / _SKETCHED <= _RANGE_ROWS:
        found, rows = _kept(_middle_values(values, keys, state), "medians")
        if found.where("not held").isEmpty() if rows is None else all(r["held"] for r in rows):
            return found.select(*keys, ((F.col("below") + F.col("above")) / 2).alias("median"))
    return _medians_by_ranges(values, keys)


def _kept(state: DataFrame, name: str) -> tuple[DataFrame, list | None]:
    """A table of one row per key as a broadcast of checked size, with its rows; or stored, and None."""
    rows = collect_lookup(state)
    if rows is None:
        return written_table(state, name), None
    return F.broadcast(state.sparkSession.createDataFrame(rows, state.schema)), rows


def _brackets(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: number of values, middle ranks, and a range that holds them, by the sketch's error twice over."""
    shares = [0.5 - 2 / _SKETCHED, 0.5 + 2 / _SKETCHED]
    marks = F.percentile_approx("value", shares, F.lit(_SKETCHED))
    ranges = values.groupBy(*keys).agg(F.count("*").alias("n"), marks.alias("marks"))
    return ranges.select(
        *keys,
        "n",
        F.floor((F.col("n") + 1) / 2).alias("first"),
        F.floor((F.col("n") + 2) / 2).alias("second"),
        F.col("marks")[0].alias("lo"),
        F.col("marks")[1].alias("hi"),
    )


def _middle_values(values: DataFrame, keys: list[str], brackets: DataFrame) -> DataFrame:
    """Both middle values per key, from the counts below its bracket and of each value in it."""
    scope = join_lookup(values, brackets.drop("n"), keys, "inner").where(F.col("value") <= F.col("hi"))
    inside = F.when(F.col("value") >= F.col("lo"), F.col("value"))
    counts = scope.groupBy(*keys, "first", "second", inside.alias("inside")).agg(F.count("*").alias("n"))
    running = Window.partitionBy(*keys).orderBy(F.col("inside").asc_nulls_first())
    ranked = counts.withColumn("upto", F.sum("n").over(running.rowsBetween(Window.unboundedPreceding, 0)))

    def value_at(rank: str) -> Column:
        return F.min(F.when(F.col("upto") >= F.col(rank), F.col("inside")))

    out_of_range = F.max(F.col("inside").isNull() & (F.col("upto") >= F.col("first")))
    held = ~out_of_range & (F.max("upto") >= F.first("second"))
    return ranked.groupBy(*keys).agg(
        value_at("first").alias("below"), value_at("second").alias("above"), held.alias("held")
    )


def _medians_by_ranges(values: DataFrame, keys: list[str]) -> DataFrame:
    """Exact medians by passes over ever smaller ranges of values.

    Each pass counts value ranges, map side first, and keeps only the range that holds the middle ranks: a
    fraction of a power of two, then fractions of that until at most ``_RANGE_ROWS`` rows are left, then
    single values.
    """
    value = F.col("value")
    state, bounds = None, None
    bucket = F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * _PER_OCTAVE)
    part = F.coalesce(F.try_divide(value - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    while True:
        state = _middle_ranges(values, keys, bucket, state)
        rows = collect_lookup(state)
        if rows is not None:
            state = F.broadcast(values.sparkSession.createDataFrame(rows, state.schema))
            open_ranges = [r for r in rows if r["below"] is None]
            found, now = max((r["rows"] for r in open_ranges), default=0), {(r["lo"], r["hi"]) for r in open_ranges}
        else:
            state = written_table(state, "medians")
            still = state.where("below is null")
            found, *now = still.agg(F.coalesce(F.max("rows"), F.lit(0)), F.sum(F.col("hi") - F.col("lo"))).first()
        if not found:
            break
        # Ranges shrink by a factor each pass; where they cannot, as between infinities, values are counted singly.
        bucket = value if found <= _RANGE_ROWS or now == bounds else F.floor(part * _PER_RANGE)
        bounds = now
    return state.select(*keys, ((F.col("below") + F.col("above")) / 2).alias("median"))


def _middle_ranges(values: DataFrame, keys: list[str], bucket: Column, state: DataFrame | None) -> DataFrame:
    """One row per key: the range [lo, hi] of the middle ranks, and both middle values once known.

    A key whose middle values are known keeps the single value ``below`` as its range, so it runs
    along through finer passes at the cost of one row.
    """
    if state is None:
        scope = values
        total = F.sum("n").over(Window.partitionBy(*keys))
        first, second = F.floor((total + 1) / 2), F.floor((total + 2) / 2)
        below = above = F.lit(None).cast("double")
        carried = []
    else:
        scope = join_lookup(values, state, keys, "inner").where(F.col("value").between(F.col("lo"), F.col("hi")))
        first, second, below, above = (F.col(c) for c in ("first", "second", "below", "above"))
        carried = ["first", "second", "below", "above"]
    ranges = scope.groupBy(*keys, *carried, bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranges.select(
        *keys,
        "bucket",
        "lo",
        "hi",
        "n",
        (F.sum("n").over(running) - F.col("n")).alias("before"),
        F.sum("n").over(running).alias("upto"),
        first.alias("first"),
        second.alias("second"),
        below.alias("below"),
        above.alias("above"),
    ).where("below is not null or (before < second and upto >= first)")
    split = F.count("*") == 2
    atom = F.min("lo") == F.max("hi")
    low = F.coalesce(F.first("below"), F.when(split, F.min_by("hi", "bucket")).when(atom, F.min("lo")))
    high = F.coalesce(F.first("above"), F.when(split, F.max_by("lo", "bucket")).when(atom, F.min("lo")))
    return ranked.groupBy(*keys).agg(
        F.coalesce(low, F.min("lo")).alias("lo"),
        F.coalesce(low, F.max("hi")).alias("hi"),
        (F.first("first") - F.min("before")).alias("first"),
        (F.first("second") - F.min("before")).alias("second"),
        low.alias("below"),
        high.alias("above"),
        F.sum("n").alias("rows"),
    )


def fit_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Median per column of a whole table; None for a column without values.

    Tasks sort blocks of rows and send points of them, which tell the middle ranks up to some rows; a second scan
    counts what lies below and each value between. Where that should not hold, ``column_medians`` is asked.
    """
    if not columns:
        return {}
    types = dict(df.dtypes)
    numbers = df.select(*[numeric.as_number(F.col(c), types[c]).alias(f"v{i}") for i, c in enumerate(columns)])
    shares = [0.5 - 2 * _POINTS_ERROR, 0.5 + 2 * _POINTS_ERROR]
    found = quantile_points(numbers, shares)
    middles = {i: f["middle"] for i, f in found.items() if f["exact"]}
    brackets = {i: f for i, f in found.items() if not f["exact"]}
    if brackets:
        between = numbers.select(*[f"v{i}" for i in brackets]).mapInArrow(
            _between([f["marks"] for f in brackets.values()]), "slot int, value double, n long"
        )
        rows = between.groupBy("slot", "value").agg(F.sum("n").alias("n"))
        # Some rows in a hundred thousand, so more values than a lookup may have only where rows are billions.
        rows = collect_lookup(rows)
        for slot, (i, f) in enumerate(brackets.items()):
            middles[i] = None if rows is None else _middle(f["n"], [(r["value"], r["n"]) for r in rows if r["slot"] == slot])
    missing = [columns[i] for i, middle in middles.items() if middle is None]
    medians = {columns[i]: (middle[0] + middle[1]) / 2 for i, middle in middles.items() if middle is not None}
    if missing:
        medians |= {r["column"]: r["median"] for r in column_medians(df, missing).collect()}
    return {c: medians.get(c) for c in columns}


def _middle(n: int, counted: list[tuple[float | None, int]]) -> tuple[float, float] | None:
    """Both middle values, from the number of smaller values (as that of None) and of each value between; None if
    they are not among these."""
    upto = sum(k for value, k in counted if value is None)
    out = []
    for rank in ((n + 1) // 2, (n + 2) // 2):
        at = upto
        for value, k in sorted(x for x in counted if x[0] is not None):
            if at < rank <= at + k:
                out.append(value)
            at += k
    return (out[0], out[1]) if len(out) == 2 else None


def _between(brackets: list[list[float]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            for slot, (low, high) in enumerate(brackets):
                values = batch.column(slot).drop_null().to_numpy(zero_copy_only=False)
                inside, n = np.unique(values[(values >= low) & (values <= high)], return_counts=True)
                below = int(np.count_nonzero(values < low))
                yield pa.record_batch(
                    [pa.array([slot] * (len(inside) + 1), pa.int32()), pa.array([None, *inside.tolist()], pa.float64()),
                     pa.array([below, *n.tolist()], pa.int64())],
                    ["slot", "value", "n"],
                )

    return run


def quantile_points(numbers: DataFrame, shares: Sequence[float], few: int = 0) -> dict[int, dict]:
    """For each column (by its place) with values: their number ``n``, the values at ``shares`` of the ranks
    (``marks``), the two middle values, whether these are ``exact``, the smallest value (``low``), and all ``few``
    distinct values, or None where there are more.

    Blocks of rows are sorted where they are, and reduced to points, each for some rows in a million; the points of
    many blocks are reduced again. Ranks are off by one row in 200,000 at most, by none where no block has more
    distinct values than points.
    """
    columns = len(numbers.columns)
    sent = numbers.select(*[F.col(c).cast("double") for c in numbers.columns]).mapInArrow(_points(columns), _POINTS_SQL)
    merged = sent.groupBy("slot", "part").applyInArrow(_merged_points, _POINTS_SQL)
    told = merged.groupBy("slot").applyInArrow(
        _told_points(list(shares), few),
        "slot int, n long, exact boolean, low double, marks array<double>, middle array<double>, few array<double>",
    )
    return {r["slot"]: r.asDict() for r in sorted(told.collect(), key=lambda r: r["slot"])}


_POINTS_SQL = "slot int, part int, exact boolean, values binary, weights binary"


def _points(columns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % _POINT_PARTS
        for batch in chunks(batches):
            for slot in range(columns):
                values = batch.column(slot).drop_null().to_numpy(zero_copy_only=False)
                if len(values):
                    values, weights = np.unique(values, return_counts=True)
                    yield _message(slot, part, True, values, weights)

    return run


def _message(slot: int, part: int, exact: bool, values: np.ndarray, weights: np.ndarray) -> pa.RecordBatch:
    values, weights, whole = _reduced(values, weights)
    row = [slot, part, exact and whole, values.tobytes(), weights.astype(np.int64).tobytes()]
    types = [pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array([v], kind) for v, kind in zip(row, types)], ["slot", "part", "exact", "values", "weights"])


def _reduced(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Sorted values as at most ``_POINTS`` points, each the middle one of as many rows, and whether all are kept."""
    if len(values) <= _POINTS:
        return values, weights, True
    upto = np.cumsum(weights)
    ends = (np.arange(_POINTS + 1) * int(upto[-1])) // _POINTS
    at = np.searchsorted(upto, (ends[:-1] + ends[1:] + 1) // 2)
    at[0] = 0  # the smallest value is kept
    return values[at], np.diff(ends), False


def _joined(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """All points of some messages, in order, equal ones as one."""
    values = np.frombuffer(b"".join(table.column("values").to_pylist()))
    weights = np.frombuffer(b"".join(table.column("weights").to_pylist()), np.int64)
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    with np.errstate(invalid="ignore"):
        starts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]) & ~np.isnan(values[:-1])))
    return values[starts], np.add.reduceat(weights, starts), all(table.column("exact").to_pylist())


def _merged_points(table: pa.Table) -> pa.Table:
    slot, part = table.column("slot")[0].as_py(), table.column("part")[0].as_py()
    values, weights, exact = _joined(table)
    return pa.Table.from_batches([_message(slot, part, exact, values, weights)])


def _told_points(shares: list[float], few: int):
    def run(table: pa.Table) -> pa.Table:
        values, weights, exact = _joined(table)
        upto = np.cumsum(weights)
        n = int(upto[-1])
        ranks = np.clip(np.ceil(np.array(shares) * n), 1, n).astype(np.int64)
        marks, middle = (values[np.searchsorted(upto, r)].tolist() for r in (ranks, [(n + 1) // 2, (n + 2) // 2]))
        all_of = values.tolist() if exact and len(values) <= few else None
        row = [table.column("slot")[0].as_py(), n, exact, float(values[0]), marks, middle, all_of]
        lists = pa.list_(pa.float64())
        types = [pa.int32(), pa.int64(), pa.bool_(), pa.float64(), lists, lists, lists]
        names = ["slot", "n", "exact", "low", "marks", "middle", "few"]
        return pa.table([pa.array([v], kind) for v, kind in zip(row, types)], names=names)

    return run


def column_modes(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per column, the smallest among equals, as rows (by..., column, mode)."""
    keys = [*by, "column"]
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return (
        df.select(*by, F.inline(F.array(*pairs)))
        .where("value is not null")
        .groupBy(*keys, "value")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    )


def fit_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    found = {r["column"]: r["mode"] for r in column_modes(df, columns).collect()} if columns else {}
    return {c: found.get(c) for c in columns}


def class_count_stats(
    df: DataFrame, column: str, floor: int | Callable[[Column], Column] | None = None
) -> DataFrame:
    """Largest non-benign class, median class size, and the smallest class below ``floor``."""
    # The class table is small, one row per class, so windows over all of it are cheap.
    whole = Window.partitionBy()
    counts = class_counts(df, column).withColumn("median_count", F.median("n").over(whole))
    limit = F.greatest(F.floor("median_count"), F.lit(2000 if floor is None else floor))
    return counts.agg(
        F.max(F.when(F.col("class") != domain.BENIGN_CLASS, F.col("n"))).alias("max_non_benign"),
        F.max("median_count").alias("median_count"),
        F.min(F.when(F.col("n") < limit, F.col("n"))).alias("smallest_boosted"),
    )
