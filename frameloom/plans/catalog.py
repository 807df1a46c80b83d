"""All queries over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import suites

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    return [importlib.import_module(f"{suites.__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(suites.__path__), key=lambda m: m.name)]


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.ORACLES
    return out
