"""Named plans: a Spark callable per name and, where SQL can say it, the check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def plan(name: str, check: str | None = None) -> Callable[[Plan], Plan]:
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"plan {name} is registered twice")
        PLANS[name] = fn
        if check is not None:
            CHECKS[name] = check
        return fn

    return register
