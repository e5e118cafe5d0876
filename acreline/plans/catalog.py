"""Named queries of the engine with their SQL counterparts.

A query is registered by its inventory id and takes Tables; the SQL is a select over the
same roles, to which their common table expressions are put in front.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acreline.plans import base

Query = Callable[[SparkSession, str], DataFrame]
FAMILIES = ("filters", "joins", "aggregates", "ordered", "sets", "scalars", "rules", "snapshots", "routes", "state", "scans", "more", "priority", "streets", "intake", "shapes", "streams", "pulls", "places")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(tables) -> DataFrame under a name, with SQL where SQL can express it."""

    def put(f: Callable[[base.Tables], DataFrame]) -> Callable:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(base.Tables(spark, sf_dir))
        if sql:
            head, _, rest = sql.strip().partition(" ")
            more, body = (", " + rest.split("\nSELECT", 1)[0], "\nSELECT" + rest.split("\nSELECT", 1)[1]) if head == "WITH" else ("", sql)
            _ORACLES[name] = f"WITH {base.SQL.strip()}{more}\n{body.strip()}"
        return f

    return put


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"acreline.plans.{family}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team leaderboard over the interaction log."""
    return queries()["e24_leaderboard"](spark, sf_dir)
