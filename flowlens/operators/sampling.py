"""Exact, seeded, class-wise sampling without large windows.

Rows of a class are ordered by a digest of seed and id. Instead of numbering all of them, the
rows are counted per digest prefix; the running sum of that small table finds the prefix where
the wanted rank falls. As long as that prefix still holds many rows, longer prefixes are counted
within it; only what remains is ranked. The resulting cut-off per class turns the selection into
a map-side comparison, whatever share of the rows a class holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric
from flowlens.operators import shared
from flowlens.operators.shared import checked_lookup, hash_key, join_lookup, repeat_rows
from flowlens.operators.stats import class_counts

# Hex digits a counting pass adds: 16**3 prefixes per class keep its shuffle small.
_DIGITS = 3
# Rows of one prefix that a single task may rank.
_RANKED_ROWS = 1_000_000


def rank_cutoffs(
    df: DataFrame, strata: Sequence[str], row_id: str, take: Column, seed: int | str, digest: str | None = None
) -> DataFrame:
    """Per stratum: its size ``n``, ``take`` (an expression over strata and n), and the digest and
    id of the last row taken. The id has to be unique. ``digest`` names a column that holds
    ``hash_key(seed, row_id)``, where it was computed before.

    ``cut`` is null where no row is taken and where all are.
    """
    strata = list(strata)
    keyed = df.select(*strata, row_id, _digest(seed, row_id, digest).alias("digest"))
    length = _DIGITS
    whole = Window.partitionBy(*strata)
    counted = keyed.groupBy(*strata, F.substring("digest", 1, length).alias("prefix")).agg(F.count("*").alias("here"))
    sized = counted.withColumn("n", F.sum("here").over(whole)).withColumn("take", take.cast("bigint"))
    ranked = sized.withColumn("rank", F.when(F.col("take") < F.col("n"), F.col("take")))
    edges, rows = _edges(ranked, strata)
    while length < 32 and _too_many(edges, rows):
        # Longer prefixes, counted only among the rows of the prefix found so far.
        scope = join_lookup(keyed, edges.where("prefix is not null"), strata, "inner").where(
            F.substring("digest", 1, length) == F.col("prefix")
        )
        length += _DIGITS
        finer = scope.groupBy(*strata, "rank", F.substring("digest", 1, length).alias("prefix")).agg(
            F.count("*").alias("here")
        )
        found, _ = _edges(finer.withColumns({"n": F.lit(0), "take": F.lit(0)}), strata)
        placed = found.select(*strata, "prefix", "rank", "here")
        edges, rows = _lookup(join_lookup(edges.select(*strata, "n", "take"), placed, strata))
    order = Window.partitionBy(*strata).orderBy("digest", row_id)
    cuts = (
        join_lookup(keyed, edges.where("prefix is not null").select(*strata, "prefix", "rank"), strata, "inner")
        .where(F.substring("digest", 1, length) == F.col("prefix"))
        .withColumn("place", F.row_number().over(order))
        .where("place = rank")
        .select(*strata, F.struct(F.col("digest"), F.col(row_id).alias("id")).alias("cut"))
    )
    return join_lookup(edges.select(*strata, "n", "take"), cuts, strata)


def _edges(counted: DataFrame, strata: list[str]):
    """Per stratum the prefix that holds ``rank``, its rows, and the rank counted from its start."""
    running = Window.partitionBy(*strata).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    upto = counted.withColumn("rest", F.col("rank") - F.sum("here").over(running) + F.col("here"))
    edge = F.max(F.when(F.col("rest").between(1, F.col("here")), F.struct("prefix", "rest", "here")))
    per_stratum = upto.groupBy(*strata).agg(F.first("n").alias("n"), F.first("take").alias("take"), edge.alias("edge"))
    return _lookup(
        per_stratum.select(
            *strata, "n", "take", F.col("edge.prefix").alias("prefix"), F.col("edge.rest").alias("rank"), F.col("edge.here").alias("here")
        )
    )


def _lookup(df: DataFrame):
    """The table as a broadcast of checked size with its rows, or stored, and None."""
    rows = shared.collect_lookup(df)
    if rows is None:
        return shared.written_table(df, "edges"), None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)), rows


def _too_many(edges: DataFrame, rows: list | None) -> bool:
    if rows is None:
        return (edges.agg(F.max("here")).first()[0] or 0) > _RANKED_ROWS
    return max((r["here"] or 0 for r in rows), default=0) > _RANKED_ROWS


def _digest(seed: int | str, row_id: str, digest: str | None) -> Column:
    return hash_key(seed, row_id) if digest is None else F.col(digest)


def with_cutoffs(
    df: DataFrame, cutoffs: DataFrame, strata: Sequence[str], row_id: str, seed: int | str, digest: str | None = None
):
    """Rows with ``n``, ``take`` and whether the row is among the taken ones."""
    joined = join_lookup(df, checked_lookup(cutoffs), strata)
    place = F.struct(_digest(seed, row_id, digest).alias("digest"), F.col(row_id).alias("id"))
    # Without a cut nothing was to be taken; a take beyond the class size takes all of it.
    chosen = (F.col("take") >= F.col("n")) | F.coalesce(place <= F.col("cut"), F.lit(False))
    return joined.withColumn("__chosen", chosen)


def stratified_split(
    df: DataFrame, label: str, row_id: str, test: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test rows; each class gives ceil(test * n) rows to the test side."""
    tagged = tag_split(df, label, row_id, test, seed)
    return (
        tagged.where(F.col("split") == "train").drop("split"),
        tagged.where(F.col("split") == "test").drop("split"),
    )


def tag_split(df: DataFrame, label: str, row_id: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """All rows with a ``split`` column: write this once instead of scanning for both sides."""
    take = F.col("n") - F.ceil(numeric.exact_fraction(test) * F.col("n"))
    cutoffs = rank_cutoffs(df, [label], row_id, take, seed)
    tagged = with_cutoffs(df, cutoffs, [label], row_id, seed)
    side = F.when(F.col("__chosen"), F.lit("train")).otherwise(F.lit("test"))
    return tagged.select(*df.columns, side.alias("split"))


def undersample(
    df: DataFrame, label: str, row_id: str, cap: Column | int, cls: str = domain.BENIGN_CLASS, seed: int = 42
) -> DataFrame:
    """Cut one class to at most ``cap`` rows, without replacement; other classes stay whole."""
    limit = F.lit(cap) if isinstance(cap, int) else cap
    take = F.when(F.col(label) == cls, F.least(F.col("n"), limit)).otherwise(F.col("n"))
    cutoffs = rank_cutoffs(df, [label], row_id, take, f"under-{seed}")
    tagged = with_cutoffs(df, cutoffs, [label], row_id, f"under-{seed}")
    return tagged.where("__chosen").select(*df.columns)


def three_times_largest_other(df: DataFrame, label: str, cls: str = domain.BENIGN_CLASS) -> int | None:
    """Cap for the dominant class: three times the next largest one."""
    largest = class_counts(df, label).where(F.col("class") != cls).agg(F.max("n").alias("m")).first()["m"]
    return None if largest is None else 3 * largest


def oversample(
    df: DataFrame,
    label: str,
    row_id: str,
    target: int | None = None,
    exempt: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Repeat rows of small classes until each has exactly ``target`` rows.

    Without ``target`` it is the size of the largest class. Each row gets target div n copies and
    the target mod n rows first in digest order one more. ``copy`` is 0 for originals.
    """
    exempted = F.col("class").isin(*exempt) if exempt else F.lit(False)
    sizes = (
        class_counts(df, label)
        .agg(F.max("n").alias("largest"), F.min(F.when(~exempted, F.col("n"))).alias("smallest"))
        .first()
    )
    target = target if target is not None else sizes["largest"] or 0
    kept = F.col(label).isin(*exempt) if exempt else F.lit(False)
    grows = ~kept & (F.col("n") < target)
    take = F.when(grows, F.lit(target) % F.col("n")).otherwise(F.lit(0))
    cutoffs = rank_cutoffs(df, [label], row_id, take, f"over-{seed}")
    tagged = with_cutoffs(df, cutoffs, [label], row_id, f"over-{seed}")
    whole = F.when(grows, F.floor(F.lit(target) / F.col("n"))).otherwise(F.lit(1))
    copies = whole + F.when(F.col("__chosen") & grows, 1).otherwise(0)
    most = target // max(sizes["smallest"] or 1, 1) + 1
    return repeat_rows(tagged, copies, "copy", row_id, most).select(*df.columns, "copy")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    whole = Window.partitionBy()  # of the class table, one row per class
    weight = F.sum("n").over(whole) / (F.count("*").over(whole) * F.col("n"))
    return class_counts(df, label).select("class", "n", weight.alias("weight"))


def with_class_weights(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(F.col("class").alias(label), F.col("weight").alias(output))
    return join_lookup(df, checked_lookup(weights), [label])


def resampling_report(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    sides = [class_counts(df, label).withColumn("stage", F.lit(s)) for s, df in (("before", before), ("after", after))]
    return sides[0].unionByName(sides[1]).select("stage", "class", "n")
