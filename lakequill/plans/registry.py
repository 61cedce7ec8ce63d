"""Registration of named queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakequill.sources.catalog import register

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Plan], Plan]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def add(fn: Plan) -> Plan:
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def sql_query(name: str, tables: str, text: str, oracle: str | None = None) -> None:
    """Register Spark SQL over views of the named tables; `oracle` is for where the twin's text must differ."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tables.split())
        return spark.sql(text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text
