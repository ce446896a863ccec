"""The registry the plan modules fill: name -> query, and name -> check SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerproof.session import one_job

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def job(spark: SparkSession, root: str) -> DataFrame:
            with one_job():
                return fn(spark, root)

        QUERIES[name] = job
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add
