"""Synthetic minority rows by interpolation towards near rows of the same class."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import median

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from flowlens.functions import domain
from flowlens.operators.neighbours import nearest_points, tile_points
from flowlens.operators.sampling import with_cutoffs, rank_cutoffs
from flowlens.operators.shared import checked_lookup, hash_fraction, hash_integer, hash_key, repeat_rows, written_table
from flowlens.operators.stats import class_counts

LEAST_FLOOR = 2000
MOST_NEIGHBOURS = 5
_PARTS = 16


def _class_facts(counts: DataFrame, floor: int | None) -> Row:
    """Floor, and of the classes below it: number, rows, smallest size, and copies the most repeated needs."""
    whole = Window.partitionBy()  # of the class table, one row per class
    least = F.lit(floor) if floor is not None else F.greatest(F.floor(F.median("n").over(whole)), F.lit(LEAST_FLOOR))
    floored = counts.withColumn("floor", least.cast("long"))
    below = F.col("n") < F.col("floor")
    return floored.agg(
        F.max("floor").alias("floor"),
        F.count_if(below).alias("classes"),
        F.sum(F.when(below, F.col("n"))).alias("rows"),
        F.min(F.when(below, F.col("n"))).alias("smallest"),
        F.max(F.when(below, (F.floor(F.col("floor") / F.col("n")) + 1) * F.col("n"))).alias("most"),
    ).first()


def smote_settings(counts: dict[str, int], floor: int | None = None, k: int | None = None) -> tuple[int, int, dict]:
    """Floor, neighbour count and the classes below the floor."""
    if not counts:
        return floor or LEAST_FLOOR, 1, {}
    floor = floor if floor is not None else max(int(median(counts.values())), LEAST_FLOOR)
    boosted = {cls: n for cls, n in counts.items() if n < floor}
    smallest = min(boosted.values(), default=2)
    if smallest < 2:
        raise ValueError("a class with a single row has no neighbour to interpolate to")
    return floor, max(1, min(k or MOST_NEIGHBOURS, smallest - 1)), boosted


def smote(
    df: DataFrame,
    label: str = domain.INTRUSION_TARGET,
    row_id: str = "flow_id",
    numbers: Sequence[str] = domain.INTRUSION_NUMERIC,
    categories: Sequence[str] = domain.INTRUSION_CATEGORICAL,
    floor: int | None = None,
    k: int | None = None,
    seed: int = 42,
    keep_id: bool = False,
) -> DataFrame:
    """Bring each class below ``floor`` up to exactly ``floor`` rows.

    A new row lies between a base row and one of its k nearest rows of the same class, at ``gap``.
    Numbers are interpolated; of each category both ends are kept (``c`` and ``c_nb``), so that its
    one-hot columns are (1-gap) and gap. Original rows have gap 0. Numbers must be imputed.
    ``keep_id`` keeps ``row_id`` as text, new rows have that of their base row and a number.
    """
    numbers, categories = list(numbers), list(categories)
    counts = checked_lookup(class_counts(df, label))
    facts = _class_facts(counts, floor)
    # The smallest class decides for all, so however many classes there are, one row comes to the driver.
    boosted = {"smallest": facts["smallest"]} if facts["classes"] else {}
    floor, k, _ = smote_settings(boosted, facts["floor"], k)
    vector = [*numbers, *categories]
    originals = df.select(
        label,
        *([F.col(row_id).cast("string").alias(row_id)] if keep_id else []),
        *[F.col(c).cast("double").alias(c) for c in numbers],
        *categories,
        *[F.col(c).alias(f"{c}_nb") for c in categories],
        F.lit(0.0).alias("gap"),
        F.lit(False).alias("synthetic"),
    )
    if not facts["classes"]:
        return originals

    small = checked_lookup(counts.where(F.col("n") < floor).select(F.col("class").alias("__small")))
    minority = df.join(small, df[label] == F.col("__small"), "left_semi").select(
        label, row_id, *[F.col(c).cast("double").alias(c) for c in numbers], *categories
    )
    deficit = F.lit(floor) - F.col("n")
    salt = f"smote-{seed}"
    # Stored with their digests, as three passes read these rows.
    minority = written_table(minority.withColumn("__digest", hash_key(salt, row_id)), "minority")
    cutoffs = rank_cutoffs(minority, [label], row_id, deficit % F.col("n"), salt, "__digest")
    tagged = with_cutoffs(minority, cutoffs, [label], row_id, salt, "__digest")
    wanted = F.floor(deficit / F.col("n")) + F.when(F.col("__chosen"), 1).otherwise(0)
    # Equal points share one neighbour search; copies of a hot point collapse before the shuffle.
    # The least id is text, so rows are sorted to be grouped: by one number first, which seldom leaves more to compare.
    first = F.xxhash64(label, *vector).alias("__first")
    points = tagged.groupBy(first, label, *vector).agg(
        F.count("*").alias("copies"), F.sum(wanted).alias("wanted"), F.min(row_id).alias("rep")
    ).drop("__first")
    # With more than k copies every neighbour is a copy, so nothing has to be searched.
    points = points.withColumn("asks", (F.col("wanted") > 0) & (F.col("copies") <= k))
    tiled = tile_points(points, label, numbers, categories, facts["rows"])

    entry = [F.col("distance"), *[F.col(f"nb_{c}") for c in vector], F.col("nb_copies")]
    # The k best of each part of what was found, then the k best of those: no list grows with the tiles asked.
    found = nearest_points(tiled, label, numbers, categories, k).withColumn("__entry", F.struct(*entry))
    part = F.pmod(F.xxhash64("__entry"), F.lit(_PARTS))
    parts = found.groupBy("rep", part.alias("__part")).agg(_best(F.collect_list("__entry"), k).alias("best"))
    ranked = parts.groupBy("rep").agg(_best(F.flatten(F.collect_list("best")), k).alias("near"))
    plain = lambda e: F.struct(*[e[f"nb_{c}"].alias(c) for c in vector])
    spread = F.flatten(
        F.transform("near", lambda e: F.array_repeat(plain(e), F.least(e["nb_copies"], F.lit(k)).cast("int")))
    )
    itself = F.array_repeat(F.struct(*vector), F.least(F.col("copies") - 1, F.lit(k)).cast("int"))
    choices = F.slice(F.concat(itself, F.coalesce(spread, F.array().cast(_vector_array(tiled, vector)))), 1, k)
    bases = tiled.where("wanted > 0").join(ranked, "rep", "left").select(
        label, "rep", "wanted", *vector, choices.alias("choices")
    )
    drawn = repeat_rows(bases, F.col("wanted"), "draw", "rep", facts["most"])
    key = F.col("key")
    drawn = drawn.withColumn("key", hash_key(seed, "rep", "draw")).withColumn("gap", hash_fraction(key, 9))
    # k never exceeds the class size minus one, so there are k choices for every point.
    pick = F.element_at("choices", (hash_integer(key, 1) % k + 1).cast("int"))
    drawn = drawn.withColumn("nb", pick)
    synthetic = drawn.select(
        label,
        *([F.concat_ws(":", "rep", "draw").alias(row_id)] if keep_id else []),
        *[(F.col(c) + F.col("gap") * (F.col(f"nb.{c}") - F.col(c))).alias(c) for c in numbers],
        *categories,
        *[F.col(f"nb.{c}").alias(f"{c}_nb") for c in categories],
        "gap",
        F.lit(True).alias("synthetic"),
    )
    return originals.unionByName(synthetic)


def _best(entries: Column, k: int) -> Column:
    return F.slice(F.array_sort(entries), 1, k)


def _vector_array(df: DataFrame, vector: Sequence[str]) -> str:
    fields = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in vector)
    return f"array<struct<{fields}>>"
