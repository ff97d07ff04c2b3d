"""Row-frame statistics with an explicit minimum number of observations.

A frame is (first, last) in rows relative to the current row. Windows run per
entity over a table that holds at most one row per entity and date, so every
window group is bounded by the length of the calendar whatever the skew of
the raw input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def series(keys: list[str] | str, order: str | list[str]) -> WindowSpec:
    keys = [keys] if isinstance(keys, str) else keys
    order = [order] if isinstance(order, str) else order
    return Window.partitionBy(*keys).orderBy(*order)


def guarded(agg: Callable[[Column], Column], x: Column | str, w: WindowSpec,
            frame: tuple[int, int], min_obs: int) -> Column:
    """``agg(x)`` over ``frame``; null with fewer than ``min_obs`` non-null values."""
    x = F.col(x) if isinstance(x, str) else x
    over = w.rowsBetween(*frame)
    return F.when(F.count(x).over(over) >= F.lit(min_obs), agg(x).over(over))


def rolling_mean(x, w, n: int, min_obs: int, lag: int = 0) -> Column:
    return guarded(F.avg, x, w, (-(n - 1) - lag, -lag), min_obs)


def rolling_std(x, w, n: int, min_obs: int, lag: int = 0) -> Column:
    return guarded(F.stddev_samp, x, w, (-(n - 1) - lag, -lag), min_obs)


def rolling_z(x, w, n: int, min_obs: int, *, exclude_current: bool = False) -> Column:
    """z-score against the trailing window, with or without the current row."""
    x = F.col(x) if isinstance(x, str) else x
    lag = 1 if exclude_current else 0
    mean = rolling_mean(x, w, n, min_obs, lag)
    std = rolling_std(x, w, n, min_obs, lag)
    return (x - mean) / F.when(std > 1e-12, std)


def log_diff(x: Column | str, w: WindowSpec, lag: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    before = F.lag(x, lag).over(w)
    return F.when((x > 0) & (before > 0), F.log(x / before))


def pct_change(x: Column | str, w: WindowSpec) -> Column:
    """x / previous - 1, and 0 where either side is missing."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.try_divide(x, F.lag(x).over(w)) - 1.0, F.lit(0.0))


def compounded(r: Column | str, w: WindowSpec, frame: tuple[int, int] | None = None) -> Column:
    """Running product of 1 + r."""
    r = F.col(r) if isinstance(r, str) else r
    lo, hi = frame or (Window.unboundedPreceding, 0)
    return F.exp(F.sum(F.log1p(r)).over(w.rowsBetween(lo, hi)))


def smoothed(x: Column | str, w: WindowSpec, keep: float, start: float | None = 1.0,
             tolerance: float = 1e-18) -> Column:
    """s[t] = keep * s[t-1] + (1 - keep) * x[t].

    Terms older than log(tolerance)/log(keep) rows weigh less than
    ``tolerance``, so the recursion is a fold over a short trailing frame
    instead of over the whole series. ``start=None`` seeds with the first x.
    """
    import math

    x = F.col(x) if isinstance(x, str) else x
    if keep <= 0:
        return x
    depth = max(2, math.ceil(math.log(tolerance) / math.log(keep)))
    recent = F.collect_list(x).over(w.rowsBetween(-depth, 0))
    seed = F.element_at(recent, 1) if start is None else F.lit(float(start))
    return F.aggregate(recent, seed, lambda s, v: s * F.lit(keep) + v * F.lit(1.0 - keep))


def sorted_median(values: Column) -> Column:
    """Median of an array column without nulls; null when empty."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    low = F.try_element_at(ordered, F.floor((n + 1) / 2).cast("int"))
    high = F.try_element_at(ordered, F.floor(n / 2 + 1).cast("int"))
    return F.when(n > 0, (low + high) / 2.0)
