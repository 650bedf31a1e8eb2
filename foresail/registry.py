"""Every query by name, and its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under a name, with the SQL that gives the same rows."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


from .plans import arma, choosing, combining, details, forecasting, modelling, nets, preparing, recipes, routing, selecting, states, structure, thetas  # noqa: E402, F401  the plans register themselves
