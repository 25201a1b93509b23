"""Registered queries: every operator over whole driver tables, with SQL for the check where one exists."""

from __future__ import annotations

from anchorkit.catalog import cohorts, comparison, learning, preparation, quality, storage, windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (cohorts, windows, quality, preparation, comparison, learning, storage):
    QUERIES.update(_module.REGISTER.queries)
    ORACLES.update(_module.REGISTER.oracles)
