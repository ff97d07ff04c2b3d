"""Registry of the driver queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIE_SHIFT = 3.3e-9

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def num(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison with other engines.

    Ratios of two-decimal amounts often end exactly on a rounding tie, where
    the last bit decides; the small shift moves them off it. Adding zero turns
    -0.0 into 0.0.
    """
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double") + F.lit(TIE_SHIFT), digits) + F.lit(0.0)


def sig_nine(x: Column | str) -> Column:
    """Numbers from 1000 on to nine significant digits, for values of very different size."""
    x = F.col(x) if isinstance(x, str) else x
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - 8)
    return F.when(F.abs(x) >= 1000, F.round(x / unit) * unit).otherwise(x)


def day(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.cast("date").cast("string")


def big(x: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x.cast("bigint")
