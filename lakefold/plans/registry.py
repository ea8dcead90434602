"""Queries by name, with the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakefold.session import configure
from lakefold.sources.tables import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir); its name is the query's."""

    def put(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return put


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL over the tables; the oracle reads the same text unless it needs its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return views(configure(spark), sf_dir).sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = oracle or text
