"""All registered queries, from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with ``QUERIES`` (name to function) and ``SQL`` (name to text).
MODULES: tuple[str, ...] = ("relational", "knowledge", "details", "modelled", "retrieving", "running", "documents")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= importlib.import_module(f"lorespark.plans.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= importlib.import_module(f"lorespark.plans.{name}").SQL
    return out
