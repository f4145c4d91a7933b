"""Number parsing, imputation, scaling and rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain number or infinity. Spark's own cast would also take "1d", "2f" and hex floats.
_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"


def coerce_number(col: Column) -> Column:
    """Parse to double; what does not parse, and NaN, become null."""
    text = col.cast("string")
    return F.when(text.rlike(_NUMBER), text).try_cast("double")


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def finite_or_null(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != F.lit(float("inf"))), col)


def as_number(col: Column, data_type: str) -> Column:
    """Double view of a column of the given simple type name."""
    if data_type == "string":
        return coerce_number(col)
    return nan_to_null(col.cast("double"))


def truncate_int(col: Column) -> Column:
    return col.cast("int")


def impute(col: Column, value: Column, guarded: bool = True) -> Column:
    """Fill nulls with ``value``; guarded means 0 when the whole column was null."""
    return F.coalesce(col, value, F.lit(0.0)) if guarded else F.coalesce(col, value)


def standardise(col: Column, mean: Column, std: Column) -> Column:
    """Population z-score; a constant column keeps scale 1."""
    return (col - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std)


def normalise_share(part: Column, total: Column) -> Column:
    """Share of the total; the part itself when there is no mass to divide by."""
    return F.when(total > 0, F.try_divide(part, total)).otherwise(part)


def percent(part: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(part, total) * 100, F.lit(0.0))


def round_capped(col: Column, ceiling: float, digits: int = 2) -> Column:
    return F.least(F.lit(float(ceiling)), F.round(col, digits))


def exact_fraction(value: float) -> Column:
    """A fraction as decimal, so that ``ceil(fraction * n)`` has no binary rounding error."""
    return F.lit(Decimal(str(value)))
