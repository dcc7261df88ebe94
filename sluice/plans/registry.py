"""All named queries of the engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import closure_cases, clouds, details, forecasts, junctions, places, scenes, simulations, streets, traffic

MODULES = (traffic, places, forecasts, junctions, simulations, streets, clouds, scenes, details, closure_cases)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for m in MODULES for k, (q, _) in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, (_, s) in m.QUERIES.items() if s}
