"""The registry of queries and, where SQL can say the same, their oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship()
            return fn(spark, sf)

        QUERIES[name] = functools.update_wrapper(run, fn)
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return keep


def load() -> None:
    from . import moving, network, places, points, routes, search  # noqa: F401
