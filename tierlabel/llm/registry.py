"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierlabel.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[name] = shipped
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register
