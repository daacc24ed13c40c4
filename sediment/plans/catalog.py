"""The named queries over the test tables, and the SQL that each must equal."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries as _queries
from .sql import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every public function of the module that takes a session and a folder."""
    return {n: f for n, f in inspect.getmembers(_queries, inspect.isfunction) if f.__module__ == _queries.__name__ and not n.startswith("_")}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
