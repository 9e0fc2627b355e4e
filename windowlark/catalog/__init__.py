"""Registered queries. Each entry pairs a DataFrame plan with an equivalent SQL statement, if there is one."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}

_MODULES = (
    "scans", "rows", "joins", "aggregates", "windows", "ordering", "sets", "scalars", "frames", "vectors", "learning",
    "dataflows", "roundtrips", "learners",
)


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = plan
        if sql is not None:
            CHECKS[name] = sql
        return plan

    return keep


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
