"""Column names, schema detection and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import domain


def normal_name(name: str) -> str:
    return name.strip().lower()


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[normal_name(c) for c in df.columns])


def first_positions(names: Sequence[str]) -> tuple[list[int], list[str]]:
    """Positions of the first of each equal name, and the names that occur more than once."""
    seen: dict[str, int] = {}
    repeated: list[str] = []
    for position, name in enumerate(names):
        if name not in seen:
            seen[name] = position
        elif name not in repeated:
            repeated.append(name)
    return sorted(seen.values()), repeated


def duplicate_warning(names: Sequence[str]) -> str:
    return domain.DUPLICATE_COLUMNS.format(names=list(names))


def dedupe_columns(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """Normalise names and keep the first column of each; also returns the warnings."""
    names = [normal_name(c) for c in df.columns]
    keep, repeated = first_positions(names)
    if not repeated:
        return df.toDF(*names), []
    unique = df.toDF(*[f"c{i}" for i in range(len(names))])
    kept = unique.select(*[F.col(f"c{i}").alias(names[i]) for i in keep])
    return kept, [duplicate_warning(repeated)]


@dataclass(frozen=True)
class Detection:
    input_type: str
    ids_matched: list[str]
    ids_missing: list[str]
    vpn_matched: list[str]
    vpn_missing: list[str]


def detect_schema(columns: Iterable[str]) -> Detection:
    """Which signatures a header carries: at least four columns of one decide."""
    present = {normal_name(c) for c in columns}
    ids, vpn = set(domain.INTRUSION_COLUMNS), set(domain.VPN_COLUMNS)
    is_ids = len(ids & present) >= domain.SIGNATURE_MINIMUM
    is_vpn = len(vpn & present) >= domain.SIGNATURE_MINIMUM
    kind = {(True, True): "mixed", (True, False): "ids", (False, True): "vpn"}.get(
        (is_ids, is_vpn), "unsupported"
    )
    return Detection(
        kind, sorted(ids & present), sorted(ids - present), sorted(vpn & present), sorted(vpn - present)
    )


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str], what: str = "input") -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"Missing required columns in {what}: {missing}")
    return df


def select_features(df: DataFrame, columns: Sequence[str] | None = domain.INTRUSION_COLUMNS) -> DataFrame:
    """The named model columns, or with ``columns=None`` everything but the targets."""
    if columns is None:
        return drop_target(df)
    return require_columns(df, columns, "features").select(*columns)


def drop_target(df: DataFrame) -> DataFrame:
    return df.drop(domain.INTRUSION_TARGET, domain.INTRUSION_FLAG, domain.VPN_TARGET)


def drop_foreign_columns(df: DataFrame) -> DataFrame:
    """Before VPN scoring of a mixed table: leave out the intrusion-only columns."""
    return df.drop(*[c for c in domain.INTRUSION_COLUMNS if c not in domain.VPN_COLUMNS])


def split_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and string column names, in schema order."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return numeric, text
