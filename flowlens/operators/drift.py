"""Concept drift as Jensen-Shannon distance of class distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric, threat
from flowlens.operators.shared import collect_lookup, written_table
from flowlens.operators.stats import class_counts


def drift(
    train: DataFrame,
    df: DataFrame,
    column: str,
    threshold: float = domain.DRIFT_THRESHOLD,
    by: Sequence[str] = (),
) -> DataFrame:
    """Distance between a stored (class, share) table and the classes of ``df``, per key.

    Without ``by`` the result is one row even for an empty input.
    """
    return drift_of_counts(train, class_counts(df, column, by), threshold, by)


def drift_of_counts(
    train: DataFrame, counts: DataFrame, threshold: float = domain.DRIFT_THRESHOLD, by: Sequence[str] = ()
) -> DataFrame:
    """Same, from ready (by..., class, n) counts; everything here is class-table sized."""
    baseline = Baseline(train)
    rows = baseline.attach(counts, "class", F.sum("n").over(Window.partitionBy(*by)))
    totals = rows.groupBy(*by).agg(baseline.distance("class").alias("js_distance"))
    detected = threat.drift_detected(F.col("js_distance"), threshold)
    return totals.select(
        *by,
        "js_distance",
        F.lit(float(threshold)).alias("threshold"),
        detected.alias("drift_detected"),
        threat.drift_status(detected).alias("drift_status"),
    )


class Baseline:
    """A stored (class, share) table, read once, ready to be compared with counts of classes.

    A class the current side lacks adds share/2 * ln 2, so it is enough to look up the classes
    that do occur and to account for the unmatched share in one term. That keeps the per-key form
    an equi-join instead of pairing each key with each stored class.
    """

    def __init__(self, train: DataFrame):
        rows = collect_lookup(train.select("class", "share"))
        stored = written_table(train.select("class", "share"), "baseline") if rows is None else None
        if stored is None:
            self.mass, self.classes = sum(r["share"] or 0.0 for r in rows), len(rows)
            stored = F.broadcast(train.sparkSession.createDataFrame(rows, train.select("class", "share").schema))
        else:
            self.mass, self.classes = stored.agg(F.sum("share"), F.count("*")).first()
        share = numeric.normalise_share(F.col("share"), F.lit(float(self.mass or 0.0)))
        self.known = stored.select(F.col("class").alias("__class"), share.alias("__p"))

    def attach(self, counts: DataFrame, column: str, mass: Column) -> DataFrame:
        """Counts with both shares of their class; rows without a class have none and no part in ``mass``."""
        counted = counts.withColumn("__mass", mass)
        return counted.join(self.known, counted[column] == F.col("__class"), "left").drop("__class")

    def distance(self, column: str) -> Column:
        """Aggregate over attached counts: the distance, null where a side has no mass."""
        present = F.col(column).isNotNull()
        p = F.coalesce("__p", F.lit(0.0))
        q = F.when(present, F.col("n") / F.col("__mass")).otherwise(F.lit(0.0))
        matched = F.count("__p")
        cells = F.coalesce(F.sum(_term(p, q) + _term(q, p)), F.lit(0.0))
        rest = F.lit(1.0) - F.coalesce(F.sum("__p"), F.lit(0.0))
        absent = F.when(matched < self.classes, F.greatest(rest, F.lit(0.0))).otherwise(F.lit(0.0))
        divergence = (cells + absent * F.ln(F.lit(2.0))) / 2
        usable = (F.max("__mass") > 0) & F.lit(bool(self.mass and self.mass > 0))
        return F.when(usable, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _term(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.ln(a * 2 / (a + b))).otherwise(F.lit(0.0))
