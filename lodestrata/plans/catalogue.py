"""All queries of the library by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("ranking", "evaluation", "graphs", "inference", "uncertainty", "sweep")


def _modules():
    return [importlib.import_module(f"lodestrata.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in _modules():
        for f in m.FUNCTIONS:
            if f.__name__ in out:
                raise ValueError(f"two queries are named {f.__name__}")
            out[f.__name__] = f
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out |= m.SQL
    return out
