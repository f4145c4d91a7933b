"""Threat vocabulary as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions import domain


def is_malicious(cls: Column) -> Column:
    return ~F.lower(cls).isin(*domain.NOT_MALICIOUS)


def is_vpn(cls: Column) -> Column:
    return cls.isin(*domain.VPN_POSITIVE)


def threat_level(score: Column, drift_detected: Column, unsupported: Column) -> Column:
    """Band of the rounded score; detected drift lifts Low to Medium."""
    return (
        F.when(unsupported, F.lit("N/A"))
        .when(score >= domain.HIGH_FROM, F.lit("High"))
        .when((score >= domain.MEDIUM_FROM) | F.coalesce(drift_detected, F.lit(False)), F.lit("Medium"))
        .otherwise(F.lit("Low"))
    )


def status_message(level: Column) -> Column:
    chain = F
    for name, message in domain.STATUS_MESSAGES.items():
        chain = chain.when(level == name, F.lit(message))
    return chain.otherwise(F.lit(domain.STATUS_UNAVAILABLE))


def drift_detected(distance: Column, threshold: float) -> Column:
    """Strictly above the threshold; an undefined distance is no drift."""
    return F.coalesce(distance > F.lit(threshold), F.lit(False))


def drift_status(detected: Column) -> Column:
    return F.when(detected, F.lit(domain.DRIFT_TEXT)).otherwise(F.lit(domain.NO_DRIFT_TEXT))


def risk_points(attack_pct: Column, vpn_pct: Column, distance: Column) -> Column:
    return (
        attack_pct * domain.ATTACK_WEIGHT
        + vpn_pct * domain.VPN_WEIGHT
        + F.coalesce(distance, F.lit(0.0)) * 100 * domain.DRIFT_WEIGHT
    )
