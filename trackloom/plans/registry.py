"""Where queries register themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.functions import columns
from trackloom.plans.views import frame, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(*inputs: str, sql: str | None = None, doubles: str = "", digits: int = 6, significant: bool = False) -> Callable:
    """Register a function of the named tables or views under its own name; its doubles are rounded.

    sql: the same in SQL, over the same views. doubles: the columns of it that are rounded. significant: to digits in all, not behind the point.
    """

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: (columns.significant if significant else columns.rounded)(f(*[frame(spark, sf_dir, x) for x in inputs]), digits)
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql, doubles, digits, significant)
        return f

    return register
