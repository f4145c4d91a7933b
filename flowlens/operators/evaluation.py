"""Confusion matrix and the scores derived from it.

Every score reads the pair counts, so the rows are scanned and shuffled once, pre-aggregated to
classes x classes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per key and (actual, predicted) pair: all any score needs."""
    return df.groupBy(*by, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count("*").alias("n")
    )


def confusion_matrix(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return sorted_matrix(pair_counts(df, actual, predicted, by), by)


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return accuracy_of(pair_counts(df, actual, predicted, by), by)


def classification_report(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return report_of(pair_counts(df, actual, predicted, by), by)


def f1_averages(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return f1_averages_of(pair_counts(df, actual, predicted, by), by)


def per_class_recall(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return recall_of(pair_counts(df, actual, predicted, by), by)


def sorted_matrix(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return pairs.orderBy(*by, "actual", "predicted")


def confusion_pivot(matrix: DataFrame, classes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Square form: one row per actual class, one column per predicted class."""
    return matrix.groupBy(*by, "actual").pivot("predicted", list(classes)).agg(F.sum("n")).na.fill(0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def accuracy_of(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    hits = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    return pairs.groupBy(*by).agg(F.try_divide(hits, F.sum("n")).alias("accuracy"))


def scores_of(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support of every class that is an actual or a predicted one."""
    hits = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    # Each pair counts once for its actual class and once for its predicted one.
    sides = F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), zero.alias("claimed"), hits.alias("hits")),
        F.struct(F.col("predicted").alias("class"), zero.alias("support"), F.col("n").alias("claimed"), zero.alias("hits")),
    )
    totals = (
        pairs.select(*by, F.inline(sides))
        .groupBy(*by, "class")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits"))
    )
    return totals.select(
        *by,
        "class",
        _ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")).alias("f1_score"),
        "support",
        "hits",
    )


def report_of(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg``."""
    scores = scores_of(pairs, by)
    measures = ("precision", "recall", "f1_score")
    support = F.sum("support")
    nothing = F.lit(None).cast("double")
    summary = scores.groupBy(*by).agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"),
                nothing.alias("precision"),
                nothing.alias("recall"),
                _ratio(F.sum("hits"), support).alias("f1_score"),
                support.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"),
                *[F.avg(m).alias(m) for m in measures],
                support.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"),
                *[_ratio(F.sum(F.col(m) * F.col("support")), support).alias(m) for m in measures],
                support.alias("support"),
            ),
        ).alias("rows")
    )
    columns = [*by, "class", *measures, "support"]
    return scores.select(*columns).unionByName(summary.select(*by, F.inline("rows")).select(*columns))


def f1_averages_of(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores_of(pairs, by).groupBy(*by).agg(
        F.avg("f1_score").alias("macro_f1"),
        _ratio(F.sum(F.col("f1_score") * F.col("support")), F.sum("support")).alias("weighted_f1"),
    )


def recall_of(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall with numerator and support; classes that never occur are left out."""
    return scores_of(pairs, by).where("support > 0").select(*by, "class", "recall", "hits", "support")
