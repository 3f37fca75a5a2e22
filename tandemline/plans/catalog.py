"""Registry of named queries and their DuckDB twins."""

from __future__ import annotations

import importlib
import os
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(tables) -> DataFrame``; ``sql`` is the DuckDB twin over the named fixture views."""

    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn

    return deco


def load() -> None:
    """Import every query module next to this one."""
    for m in pkgutil.iter_modules([os.path.dirname(__file__)]):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__package__}.{m.name}")


def bound(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Tables(spark, sf_dir))
