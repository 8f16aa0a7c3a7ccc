"""Registered queries over the test tables, each with its DuckDB oracle.

Every query reads the whole provided tables through the adapter view
(``sources.adapter``); the oracle is the same computation as SQL text over
the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapter import observations

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir)


# Load the query modules so their ``register`` calls run.
from . import queries_core, queries_io, queries_more  # noqa: E402,F401
