"""All queries of the package by name, with their SQL where SQL can say the same."""

from __future__ import annotations

import importlib
import importlib.util
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataline.plans import core_queries

Query = Callable[[SparkSession, str], DataFrame]



def _parts() -> list:
    parts: list = [core_queries]
    for name in ["strataline.plans.reference_queries", "strataline.plans.layout_queries"]:
        if importlib.util.find_spec(name):
            parts.append(importlib.import_module(name))
    return parts


def core() -> tuple[dict[str, Query], dict[str, str]]:
    q: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for m in _parts():
        q |= m.QUERIES
        sql |= getattr(m, "ORACLE_SQL", {})
    return q, sql


def everything() -> dict[str, Query]:
    """The core queries and those of any further package of the library that has some (module ``queries``)."""
    q, _ = core()
    root = importlib.import_module(__name__.split(".")[0])
    for found in pkgutil.iter_modules(root.__path__):
        name = f"{root.__name__}.{found.name}.queries"
        if found.ispkg and importlib.util.find_spec(name):
            q |= importlib.import_module(name).QUERIES
    return q
