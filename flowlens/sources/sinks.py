"""Writers of predictions, corpora and drift verdicts; samples and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from flowlens.functions import domain
from flowlens.operators.schema import require_columns
from flowlens.operators.soc import ATTACK, VPN


def _write(df: DataFrame, path: str, fmt: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # By default the CSV writer would trim values.
        # Nor does it double quotes inside quoted text.
        writer = writer.options(
            header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", escape='"'
        )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_predictions(df: DataFrame, path: str, fmt: str = "csv") -> bool:
    """Write scored rows; without a prediction column nothing is written and False returned."""
    if ATTACK not in df.columns and VPN not in df.columns:
        return False
    _write(df, path, fmt)
    return True


def write_clean(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Persist a merged or cleaned corpus, for instance partitioned by source file or day."""
    _write(df, path, fmt, partition_by)


def write_drift(df: DataFrame, path: str, fmt: str = "csv") -> None:
    keys = [c for c in df.columns if c not in ("js_distance", "threshold", "drift_detected", "drift_status")]
    _write(df.select(*keys, "js_distance", "threshold", "drift_status"), path, fmt)


def sample_input(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """First ``n`` rows in key order, model columns only: a small input for trying out scoring."""
    require_columns(df, domain.INTRUSION_COLUMNS, "sample")
    return df.orderBy(order).limit(n).select(*domain.INTRUSION_COLUMNS)


def preview(df: DataFrame, order: str | Sequence[str], n: int = 10) -> DataFrame:
    keys = [order] if isinstance(order, str) else list(order)
    return df.orderBy(*keys).limit(n)
