"""Every operator as a query over whole driver tables, each with the DuckDB SQL that must give the same rows.

The tables hold no packages, so each query states which columns stand for what. Keys are those of
the survey's catalog.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relsift.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle if SQL can express it."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


from relsift.plans.catalog import files, history, inputs, packages, scores, text  # noqa: E402, F401  each registers its queries
