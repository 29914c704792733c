"""Where the catalogs put their queries and the SQL each is checked against."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stakewatch.plans.oracle import with_views
from stakewatch.session import size_partitions

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def in_utc(function: Query) -> Query:
    """Dates and days are those of UTC, whatever zone the session came with; partitions are sized by the input."""

    @functools.wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        size_partitions(spark, sf_dir)
        return function(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is its oracle and ``views`` the named SQL views it reads."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = in_utc(function)
        if sql is not None:
            ORACLES[name] = with_views(sql, views)
        return function

    return add
