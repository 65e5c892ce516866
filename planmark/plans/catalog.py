"""All registered queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from planmark.plans.views import Views

MODULES = ("tables_plan", "extraction_plan", "spatial_plan", "summary_plan", "scoring_plan", "graph_plan", "stream_plan")


def _modules():
    return [import_module(f"planmark.plans.{name}") for name in MODULES]


def _bind(fn) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: fn(Views(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for module in _modules() for name, fn in module.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
