"""Registry of the queries and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from duelbook.plans.views import duck_sql
from duelbook.session import tune

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "", extra: str = ""):
    """Register a query; ``sql`` is read over the named derived views by another engine."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(tune(spark), sf_dir)
        if sql:
            ORACLES[name] = duck_sql(views, sql, extra) if views else sql
        return function

    return register


def r6(column) -> Column:
    """Six decimals, as both engines are compared; no negative zero."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, 6) + F.lit(0.0)


def day(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("string")


def big(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("long")
