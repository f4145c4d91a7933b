"""All registered queries; importing the parts fills the registry."""

from __future__ import annotations

from flowlens.plans import catalog_aggregates, catalog_columns, catalog_files, catalog_training  # noqa: F401
from flowlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
