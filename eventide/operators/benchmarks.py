"""Benchmark return series over a forward-filled price grid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import rolling as R
from eventide.operators import interval_top as IT
from eventide.operators.candidates import ENTITY, day_numbers, with_dates


def index_returns(benchmarks: DataFrame) -> DataFrame:
    """(symbol, date, ret) of adjusted closes."""
    w = R.series("symbol", "date")
    return benchmarks.select("symbol", "date", R.pct_change("adjusted_close", w).alias("ret"))


def grid_state(grid: DataFrame, key: str, lookback: int = 252) -> DataFrame:
    """Grid with the day's return and the inverse volatility and dollar volume known the day before.

    Days before a name's first price count as zero returns in its volatility.
    """
    w = R.series(key, "seq")
    out = grid.withColumn("ret", R.pct_change("adjusted_close", w))
    vol = R.rolling_std("ret", w, lookback, lookback // 4, 1)
    out = out.withColumn("_dv", F.col("adjusted_close") * F.col("volume"))
    return (out.withColumn("inv_vol", F.when(vol > 0, F.lit(1.0) / vol))
            .withColumn("dollar_volume",
                        R.rolling_mean("_dv", w, lookback, lookback // 4, 1)).drop("_dv"))


def _weighted(weight: Column) -> Column:
    known = F.when(weight.isNotNull(), F.col("ret"))
    return F.coalesce(F.try_divide(F.sum(weight * F.col("ret")),
                                   F.sum(F.when(known.isNotNull(), weight))), F.lit(0.0))


def universe_returns(state: DataFrame, n_names: Column) -> DataFrame:
    """Per day: equal, inverse-volatility and dollar-volume weighted returns of all names.

    ``n_names`` counts every name that ever has a price, listed yet or not.
    """
    return state.groupBy("date").agg(
        (F.sum("ret") / F.max(n_names)).alias("equal_weight"),
        _weighted(F.col("inv_vol")).alias("inverse_vol"),
        _weighted(F.col("dollar_volume")).alias("dollar_volume"))


def active_counts(predictions: DataFrame, calendar: DataFrame, days: DataFrame,
                  key: str = ENTITY) -> DataFrame:
    """(key, seq, active, started, ended): how many names are active each day, and the changes.

    A name's overlapping or adjoining predictions are merged first. Counts then
    follow from running sums of starts and ends, so the cost is one row per
    interval and one per key and day, not one per active name and day.
    """
    numbers = day_numbers(calendar, days)
    span = calendar.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    start = numbers.select(F.col("date").alias("_s"), F.col("after").alias("_a"))
    stop = numbers.select(F.col("date").alias("_e"), F.col("before").alias("_b"))
    columns = [ENTITY] if key == ENTITY else [ENTITY, key]
    placed = (predictions.where(F.col("entry_date").isNotNull() & F.col("exit_date").isNotNull())
              .select(*columns, F.greatest("entry_date", span["lo"]).alias("_s"),
                      F.least("exit_date", span["hi"]).alias("_e"))
              .join(F.broadcast(start), "_s").join(F.broadcast(stop), "_e")
              .where(F.col("_a") <= F.col("_b")).select(*columns, "_a", "_b"))
    w = R.series(ENTITY, ["_a", "_b"])
    reach = F.max("_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("_a") > reach + 1, F.lit(True))
    islands = (placed.withColumn("_new", fresh.cast("int"))
               .withColumn("_i", F.sum("_new").over(w))
               .groupBy(*columns, "_i").agg(F.min("_a").alias("_a"), F.max("_b").alias("_b")))
    change = F.explode(F.array(
        F.struct(F.col("_a").alias("seq"), F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct((F.col("_b") + 1).alias("seq"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    steps = (islands.select(key, change.alias("c")).groupBy(key, "c.seq")
             .agg(F.sum("c.up").alias("started"), F.sum("c.down").alias("ended")))
    ahead = R.series(key, "seq").rowsBetween(Window.unboundedPreceding, 0)
    held = (steps.withColumn("active", F.sum(F.col("started") - F.col("ended")).over(ahead))
            .withColumn("_to", F.coalesce(F.lead("seq").over(R.series(key, "seq")) - 1,
                                          days.agg(F.max("seq")).scalar())))
    spread = held.where(F.col("_to") >= F.col("seq")).select(
        key, F.col("seq").alias("_from"), "active", "started", "ended",
        F.explode(F.sequence("seq", "_to")).alias("seq"))
    today = F.col("seq") == F.col("_from")
    return spread.select(key, "seq", "active", *[
        F.when(today, F.col(c)).otherwise(F.lit(0)).alias(c) for c in ("started", "ended")])


def active_returns(counts: DataFrame, state: DataFrame, key: str = ENTITY,
                   cost_bps: float = 10.0) -> DataFrame:
    """Per day: equal and inverse-volatility returns of the active names, and the latter after cost.

    Names sharing a price series share weight and return, so each enters with
    its count. The cost is half the absolute weight change: of names that stay,
    enter and leave.
    """
    n, iv = F.col("active"), F.col("inv_vol")
    rows = state.join(counts, [key, "seq"], "left").na.fill(0, ["active", "started", "ended"])
    totals = rows.groupBy("seq").agg(F.sum(n * iv).alias("_t"))
    w = R.series(key, "seq")
    share = F.coalesce(F.try_divide(iv, F.col("_t")), F.lit(0.0))
    moved = (rows.join(F.broadcast(totals), "seq").withColumn("_w", share)
             .withColumn("_before", F.coalesce(F.lag("_w").over(w), F.lit(0.0))))
    change = (F.abs(F.col("_w") - F.col("_before")) * (n - F.col("started"))
              + F.col("_w") * F.col("started") + F.col("_before") * F.col("ended"))
    per = moved.groupBy("seq", "date").agg(
        F.coalesce(F.try_divide(F.sum(n * F.col("ret")), F.sum(n)), F.lit(0.0))
        .alias("equal_weight_active"),
        F.coalesce(F.try_divide(F.sum(n * iv * F.col("ret")), F.sum(n * iv)), F.lit(0.0))
        .alias("inverse_vol_active"), (F.sum(change) / 2.0 * (cost_bps / 10000.0)).alias("_cost"))
    # The first day of the grid has no day before it to trade from.
    first = state.agg(F.min("seq")).scalar()
    cost = F.when(F.col("seq") > first, F.col("_cost")).otherwise(F.lit(0.0))
    return per.select("date", "equal_weight_active", "inverse_vol_active",
                      (F.col("inverse_vol_active") - cost).alias("inverse_vol_active_after_cost"))


def hash_order(seed: int, *parts: Column | str) -> Column:
    """A reproducible pseudo-random order that does not depend on partitioning."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[
        F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def active_names(pieces: DataFrame, days: DataFrame) -> DataFrame:
    """(seq, as_of, names): how many of the intervals hold on each day, from running sums of starts and ends."""
    change = F.explode(F.array(F.struct(F.col(IT.FIRST).alias("seq"), F.lit(1).alias("n")),
                               F.struct((F.col(IT.LAST) + 1).alias("seq"), F.lit(-1).alias("n"))))
    steps = pieces.select(change.alias("c")).groupBy("c.seq").agg(F.sum("c.n").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return (days.select("seq", F.col("date").alias("as_of")).join(steps, "seq", "left")
            .select("seq", "as_of", F.sum(F.coalesce("_n", F.lit(0))).over(ahead).alias("names")))


def random_names(pieces: DataFrame, days: DataFrame, n: int = 50, seed: int = 42,
                 stage: Callable[[DataFrame], DataFrame] = lambda df: df, spare: float = 4.0) -> DataFrame:
    """n active names of each day in a reproducible random order of that day, numbered ``_k`` from 1.

    ``pieces`` are the names' intervals (``active_pieces``). Every name draws anew on every day.
    Each task goes through the days of its intervals, and only names whose number falls below a
    share expected to hold ``spare`` * n of the day's names leave it. Days on which fewer than n
    pass are ordered in full, so the draw is exact. ``stage`` may write the first draw, a few
    rows per day, before it is checked.
    """
    share = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.lit(spare * n), F.col("names"))), F.lit(1.0))
    limit = F.lower(F.lpad(F.hex(F.floor(share * float(1 << 32)).cast("bigint")), 9, F.lit("0")))
    limits = stage(active_names(pieces, days).select("seq", "as_of", F.least("names", F.lit(n)).alias("_want"), limit.alias("_limit")))
    order = Window.partitionBy("seq").orderBy("_h", ENTITY)

    def coded(wanted: DataFrame) -> DataFrame:
        spread = pieces.withColumn("seq", F.explode(F.sequence(IT.FIRST, IT.LAST))).drop(IT.FIRST, IT.LAST)
        return spread.join(F.broadcast(wanted), "seq").withColumn("_h", hash_order(seed, "as_of", ENTITY))

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_h", "_want", "_limit")

    drawn = stage(first(coded(limits).where(F.concat(F.lit("0"), F.substring("_h", 1, 8)) < F.col("_limit"))))
    got = drawn.groupBy("seq").agg(F.count(F.lit(1)).alias("_got"))
    short = limits.join(got, "seq", "left").where(F.coalesce("_got", F.lit(0)) < F.col("_want")).drop("_got")
    return (drawn.join(F.broadcast(short.select("seq")), "seq", "left_anti")
            .unionByName(first(coded(short))))


def strongest_signals(pieces: DataFrame, days: DataFrame, n: int = 50) -> DataFrame:
    """The n largest positive signals of each day, numbered ``_k`` from 1."""
    last = days.agg(F.max("seq")).first()[0] or 0
    rows = pieces.where(F.col("predicted_signal") > 0).select(ENTITY, "predicted_signal", IT.FIRST, IT.LAST)
    top = IT.top_by_day(rows, last, lambda: [F.col("predicted_signal").desc(), F.col(ENTITY)], n, lead="predicted_signal")
    return with_dates(top, days).select("as_of", "_k", F.col("predicted_signal").alias("_s"))


def random_returns(names: DataFrame, state: DataFrame, key: str = ENTITY) -> DataFrame:
    """Inverse-volatility return of each day's random names."""
    priced = names.join(state.select(key, "seq", "date", "ret", "inv_vol"), [key, "seq"])
    return priced.groupBy("date").agg(_weighted(F.col("inv_vol")).alias("random_n"))


def shuffled_returns(signals: DataFrame, names: DataFrame, state: DataFrame,
                     key: str = ENTITY) -> DataFrame:
    """Return of the day's strongest signals handed to its random names.

    Equal in distribution to shuffling all signals over all names and keeping
    the best, but only the few signals and names of a day ever meet. Weights
    are signal times inverse volatility.
    """
    dealt = signals.join(names, ["as_of", "_k"])
    priced = dealt.join(state.select(key, "seq", "date", "ret", "inv_vol"), [key, "seq"])
    return priced.groupBy("date").agg(
        _weighted(F.col("inv_vol") * F.col("_s")).alias("shuffled_signal"))
