"""Vocabularies of any size as tables: dense codes, feature slots and their lookup.

The encoder of ``encoding`` holds every distinct text on the driver, which suits columns of some
thousand values. Here the distinct values are counted by key, dealt out by range and numbered there;
rows meet them in joins, frequent values by broadcast and the rest by shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.encoding import PREFIX
from flowlens.operators.shared import LOOKUP_ROWS, written_table

# Values that one task numbers, and the share of all rows from which on a value is looked up by broadcast.
PART_VALUES = 1_000_000
HOT_SHARE = 20_000


@dataclass(frozen=True)
class Vocabulary:
    """``codes``: column, value, code (0 for the smallest value of a column), rows. ``sizes``: values per column."""

    codes: DataFrame
    sizes: dict[str, int]
    rows: int

    def first_slots(self, numbers: Sequence[str] = ()) -> dict[str, int]:
        """Slot of each column's first value, counted from 1, the numbers being in front."""
        slots, at = {}, len(numbers) + 1
        for column, size in self.sizes.items():
            slots[column] = at
            at += size
        return slots


def fit_vocabulary(prepared: DataFrame, columns: Sequence[str]) -> Vocabulary:
    """Distinct values of the prepared ``columns``, numbered in their order. Missing values get no number.

    The range bounds come from a sample, so the parts are written down before they are numbered.
    """
    columns = list(dict.fromkeys(columns))
    pairs = [F.struct(F.lit(c).alias("column"), F.col(PREFIX + c).cast("string").alias("value")) for c in columns]
    spark = prepared.sparkSession
    if not pairs:
        return Vocabulary(spark.createDataFrame([], "column string, value string, code long, rows long"), {}, 0)
    counted = written_table(
        prepared.select(F.inline(F.array(*pairs))).where("value is not null")
        .groupBy("column", "value").agg(F.count("*").alias("rows")),
        "values",
    )
    parts = counted.count() // PART_VALUES + 1
    dealt = written_table(
        counted.repartitionByRange(parts, "column", "value").withColumn("part", F.spark_partition_id()), "value-parts"
    )
    # One row per part, and one more for each column that ends within a part.
    sums = dealt.groupBy("column", "part").agg(F.count("*").alias("n"), F.sum("rows").alias("of_rows"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("column").alias("in_column"), F.col("part").alias("in_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    place = F.row_number().over(Window.partitionBy("column", "part").orderBy("value")) - 1
    codes = (
        dealt.withColumn("place", place)
        .join(starts, (F.col("column") == F.col("in_column")) & (F.col("part") == F.col("in_part")))
        .select("column", "value", (F.col("start") + F.col("place")).cast("long").alias("code"), "rows")
    )
    found = {r["column"]: r for r in sums.groupBy("column").agg(F.sum("n").alias("n"), F.sum("of_rows").alias("r")).collect()}
    sizes = {c: found[c]["n"] if c in found else 0 for c in columns}
    return Vocabulary(written_table(codes, "vocabulary"), sizes, max((r["r"] for r in found.values()), default=0))


def with_codes(prepared: DataFrame, vocabulary: Vocabulary, row_id: str, lookup_rows: int = LOOKUP_ROWS) -> DataFrame:
    """Add ``<column>_code``, null for missing and unseen values.

    A column of at most ``lookup_rows`` values is looked up by broadcast. Of a larger one, only values
    with more than one row in ``HOT_SHARE`` are, fewer than that many; the others meet by shuffle, and
    rows that need no lookup there are spread by their id.
    """
    out = prepared
    for column, size in vocabulary.sizes.items():
        word = F.col(PREFIX + column)
        own = vocabulary.codes.where(F.col("column") == column).select(F.col("value").alias("__value"), F.col("code").alias("__code"), "rows")
        if size <= lookup_rows:
            few = F.broadcast(own.drop("rows"))
            out = out.join(few, word == F.col("__value"), "left").withColumnRenamed("__code", f"{column}_code").drop("__value")
            continue
        often = F.col("rows") > vocabulary.rows // HOT_SHARE
        hot = F.broadcast(own.where(often).select(F.col("__value").alias("__hot"), F.col("__code").alias("__hot_code")))
        rare = own.where(~often).select("__value", "__code", F.xxhash64("__value").alias("__hash"))
        out = out.join(hot, word == F.col("__hot"), "left")
        asks = F.col("__hot_code").isNull() & word.isNotNull()
        out = out.withColumns(
            {"__asked": F.when(asks, word), "__key": F.when(asks, F.xxhash64(word)).otherwise(F.xxhash64(F.col(row_id)))}
        )
        out = out.join(rare, (F.col("__key") == F.col("__hash")) & (F.col("__asked") == F.col("__value")), "left")
        out = out.withColumn(f"{column}_code", F.coalesce("__hot_code", "__code")).drop(
            "__hot", "__hot_code", "__asked", "__key", "__value", "__code", "__hash"
        )
    return out


def feature_table(vocabulary: Vocabulary, numbers: Sequence[str] = ()) -> DataFrame:
    """Slot (from 1) and feature of every place of the feature vector, numbers first."""
    spark = vocabulary.codes.sparkSession
    front = spark.createDataFrame([(i, c) for i, c in enumerate(numbers, 1)], "slot long, feature string")
    firsts = [(c, s) for c, s in vocabulary.first_slots(numbers).items()]
    first = F.broadcast(spark.createDataFrame(firsts, "of_column string, first long"))
    named = vocabulary.codes.join(first, F.col("column") == F.col("of_column")).select(
        (F.col("first") + F.col("code")).alias("slot"), _feature(F.col("column"), F.col("value"))
    )
    return front.unionByName(named)


def _feature(column, value):
    return F.concat(column, F.lit("_"), F.when(value == " ", F.lit("")).otherwise(value)).alias("feature")


def slotted_features(
    prepared: DataFrame, vocabulary: Vocabulary, numbers: Sequence[str], row_id: str, lookup_rows: int = LOOKUP_ROWS
) -> DataFrame:
    """Long form (id, slot, feature, value) of the encoded rows, zero slots left out.

    Missing and unseen values have no entry, as in ``encoding.exploded_features``.
    """
    first = vocabulary.first_slots(numbers)
    entries = [
        F.when(
            F.col(PREFIX + c) != 0,
            F.struct(F.lit(i).cast("long").alias("slot"), F.lit(c).alias("feature"), F.col(PREFIX + c).cast("double").alias("value")),
        )
        for i, c in enumerate(numbers, 1)
    ]
    for c in vocabulary.sizes:
        slot = (F.lit(first[c]) + F.col(f"{c}_code")).cast("long").alias("slot")
        hot = F.struct(slot, _feature(F.lit(c), F.col(PREFIX + c)), F.lit(1.0).alias("value"))
        entries.append(F.when(F.col(f"{c}_code").isNotNull(), hot))
    coded = with_codes(prepared, vocabulary, row_id, lookup_rows)
    return coded.select(row_id, F.inline(F.array_compact(F.array(*entries))))
