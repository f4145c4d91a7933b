"""Security roll-up: percentages, top class, risk and threat level."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import domain, numeric, threat
from flowlens.operators.drift import Baseline
from flowlens.operators.schema import detect_schema

ATTACK = "predicted_attack"
VPN = "predicted_vpn"
KIND = "input_type"


def _counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, and rows seen as VPN, per key and attack prediction: a small table all metrics derive from."""
    attack = F.col(ATTACK) if ATTACK in df.columns else F.lit(None).cast("string")
    vpn = threat.is_vpn(F.col(VPN)) if VPN in df.columns else F.lit(False)
    supported = F.col(KIND) != "unsupported" if KIND in df.columns else F.lit(True)
    return df.groupBy(*by, attack.alias(ATTACK)).agg(
        F.count("*").alias("n"), F.count_if(vpn).alias("vpn"), F.coalesce(F.max(supported), F.lit(False)).alias("supported")
    )


def _rows_where(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))


def _parts() -> list[Column]:
    """Aggregates over the counts of a key."""
    attack = F.col(ATTACK)
    return [
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        _rows_where(attack.isNotNull()).alias("total_attacks"),
        _rows_where(threat.is_malicious(attack)).alias("malicious"),
        F.coalesce(F.sum("vpn"), F.lit(0)).alias("vpn"),
    ]


def _shares() -> dict[str, Column]:
    total = F.col("total_records")
    return {
        "attack_percentage": numeric.percent(F.col("total_attacks"), total),
        "malicious_percentage": numeric.percent(F.col("malicious"), total),
        "vpn_percentage": numeric.percent(F.col("vpn"), total),
    }


def percentages(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with an attack prediction of any class, of a malicious class, and of VPN."""
    totals = _counts(df, by).groupBy(*by).agg(*_parts()).withColumns(_shares())
    return totals.select(*by, "total_records", "total_attacks", *_shares())


def _top(column: str) -> Column:
    """Largest malicious class of a key's counts, else the largest class, else N/A; ties by name."""
    order = F.struct(~threat.is_malicious(F.col(column)), -F.col("n"), F.col(column))
    return F.coalesce(F.min_by(column, F.when(F.col(column).isNotNull(), order)), F.lit("N/A"))


def top_attack(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Largest malicious class of (by..., class, n); else the largest class; else N/A."""
    return counts.groupBy(*by).agg(_top("class").alias("top_attack"))


def soc_metrics(
    df: DataFrame, train: DataFrame | None, by: Sequence[str] = (), input_type: str | None = None
) -> DataFrame:
    """All security metrics per key from one aggregation of the scored table.

    ``train`` is the stored (class, share) table; without it, or without attack predictions, the
    drift part counts 0. A key is unsupported if all its rows are, by their ``input_type`` column or,
    where the table has none, by ``input_type``, which defaults to what the columns say.
    """
    by = list(by)
    kind = input_type or (None if KIND in df.columns else detect_schema(df.columns).input_type)
    counts = _counts(df, by)
    drifts = train is not None and ATTACK in df.columns
    distance = F.lit(None).cast("double")
    if drifts:
        baseline = Baseline(train)
        mass = F.sum(F.when(F.col(ATTACK).isNotNull(), F.col("n"))).over(Window.partitionBy(*by))
        counts = baseline.attach(counts, ATTACK, mass)
        distance = baseline.distance(ATTACK)
    supported = F.coalesce(F.max("supported"), F.lit(True)) & F.lit(kind != "unsupported")
    totals = counts.groupBy(*by).agg(
        *_parts(), _top(ATTACK).alias("top_attack"), distance.alias("js_distance"), supported.alias("supported")
    )
    unsupported = ~F.col("supported")
    detected = threat.drift_detected(F.col("js_distance"), domain.DRIFT_THRESHOLD) if drifts else F.lit(False)
    points = threat.risk_points(F.col("attack_percentage"), F.col("vpn_percentage"), F.col("js_distance"))
    risk = F.when(unsupported, F.lit(0.0)).otherwise(numeric.round_capped(points, domain.RISK_CEILING))
    level = threat.threat_level(F.col("risk_score"), F.col("drift_detected"), unsupported)
    return (
        totals.withColumns(_shares())
        .withColumn("drift_detected", F.coalesce(detected, F.lit(False)))
        .withColumn("risk_score", risk)
        .withColumn("threat_level", level)
        .select(
            *by,
            "total_records",
            "total_attacks",
            *[F.round(c, 2).alias(c) for c in _shares()],
            F.when(unsupported, F.lit("N/A")).otherwise(F.col("top_attack")).alias("top_attack"),
            "js_distance",
            "drift_detected",
            "risk_score",
            "threat_level",
            threat.status_message(F.col("threat_level")).alias("status_message"),
        )
    )
