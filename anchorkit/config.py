"""Run configuration: defaults merged with the caller's nested settings."""

from __future__ import annotations

from copy import deepcopy
from typing import Any

# Defaults of the cohort, the outcome classes and the preparation.
DEFAULTS: dict[str, Any] = {
    "seed": 42,
    "data": {"source": "parquet", "table_sources": {}},
    "cohort": {"min_age": 18, "min_los_hours": 4, "max_los_days": 30, "first_only": True},
    "los_bins": {"short_threshold_days": 2, "long_threshold_days": 7},
    "preparation": {"test_size": 0.20, "val_size": 0.10, "cv_folds": 5, "imputation_strategy": "median", "scaling": "standard"},
    "caps": {"mlp": 10_000},
    "top_units": 8,
}


def merged(overrides: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with ``overrides`` laid over them, level by level."""
    def lay(base: dict, extra: dict) -> dict:
        for key, value in extra.items():
            base[key] = lay(base.get(key, {}), value) if isinstance(value, dict) and isinstance(base.get(key), dict) else value
        return base
    return lay(deepcopy(DEFAULTS), overrides or {})
