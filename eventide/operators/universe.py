"""Liquidity, price and history filters that see only past prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S

from eventide.functions import rolling as R
from eventide.operators.asof import asof_lookup

# Reasons reported for dropped samples.
NO_SERIES = "filter_no_price_series"
SHORT_HISTORY = "filter_insufficient_history"
LOW_PRICE = "filter_below_min_price"
LOW_VOLUME = "filter_below_min_adv"


@dataclass(frozen=True)
class UniverseRules:
    min_price: float = 5.0
    min_dollar_volume: float = 10_000_000.0
    min_events: int = 12
    min_years: float = 5.0
    lookback: int = 252
    max_stale_days: int = 10

    @property
    def min_rows(self) -> int:
        return int(self.min_years * 252)


def with_dollar_volume(prices: DataFrame) -> DataFrame:
    return prices.withColumn("dollar_volume", F.col("adjusted_close") * F.col("volume"))


def with_trailing_dollar_volume(prices: DataFrame, key: str, lookback: int, min_obs: int,
                                lag: int = 1, out: str = "trailing_dv") -> DataFrame:
    """Mean dollar volume of the last ``lookback`` rows, ``lag`` rows ago."""
    w = R.series(key, "date")
    return with_dollar_volume(prices).withColumn(
        out, R.rolling_mean("dollar_volume", w, lookback, min_obs, lag))


def point_in_time_universe(prices: DataFrame, events: DataFrame, as_of: str, key: str,
                           rules: UniverseRules) -> DataFrame:
    """Entities that are liquid, priced, seasoned and reporting on ``as_of``."""
    day = F.lit(as_of).cast("date")
    known = prices.where(F.col("date") <= day)
    liquid = (with_trailing_dollar_volume(known, key, rules.lookback, rules.lookback // 2)
              .groupBy(key)
              .agg(F.max("date").alias("last_date"), F.count(F.lit(1)).alias("rows"),
                   F.max_by("adjusted_close", "date").alias("last_close"),
                   F.max_by(F.struct("trailing_dv"), "date").alias("_dv"))
              .where((F.col("last_date") >= F.date_sub(day, rules.max_stale_days))
                     & (F.col("last_close") >= rules.min_price)
                     & (F.col("rows") >= rules.min_rows)
                     & (F.col("_dv.trailing_dv") >= rules.min_dollar_volume)))
    reporting = (events.where(S.event_day(events) < day).groupBy(key)
                 .agg(F.count(F.lit(1)).alias("events"))
                 .where(F.col("events") >= rules.min_events))
    return (liquid.join(reporting, key)
            .select(key, day.alias("as_of"), "last_close", F.col("_dv.trailing_dv")
                    .alias("trailing_dv"), "rows", "events"))


def apply_sample_filter(samples: DataFrame, prices: DataFrame, key: str, rules: UniverseRules,
                        extra_lag: int = 1) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped with ``exclusion_reason``) by the state before entry.

    The state is read at the last row before entry, from columns that are
    already ``extra_lag`` rows old; 0 gives the plain last known row.
    """
    w = R.series(key, "date")
    close = F.col("adjusted_close")
    state = with_trailing_dollar_volume(prices, key, rules.lookback, rules.lookback // 4,
                                        extra_lag)
    state = (state.withColumn("_rows", F.row_number().over(w))
             .withColumn("_close", F.coalesce(F.lag(close, extra_lag).over(w), close)
                         if extra_lag else close))
    seen = asof_lookup(samples, state, [key], "entry_date", "date",
                       ["_rows", "_close", "trailing_dv"], strict=True)
    priced = prices.select(key).distinct().withColumn("_priced", F.lit(True))
    seen = seen.join(priced, key, "left")
    below = lambda c, x: F.coalesce(F.col(c) < x, F.lit(True))
    reason = (F.when(F.col("_priced").isNull(), NO_SERIES)
              .when(below("_rows", rules.min_rows), SHORT_HISTORY)
              .when(below("_close", rules.min_price), LOW_PRICE)
              .when(below("trailing_dv", rules.min_dollar_volume), LOW_VOLUME))
    judged = seen.withColumn("_reason", reason).drop("_rows", "_close", "trailing_dv", "_priced")
    kept = judged.where(F.col("_reason").isNull()).drop("_reason")
    dropped = (judged.where(F.col("_reason").isNotNull())
               .select("sample_id", F.col("_reason").alias("exclusion_reason")))
    return kept, dropped


def company_holdout(df: DataFrame, entity: str, held_buckets: list[int],
                    buckets: int = 10) -> DataFrame:
    """Add ``held_out``: whether the entity's hash bucket is among those held out."""
    from eventide.functions.scalars import hash_bucket
    return df.withColumn("held_out", hash_bucket(entity, buckets).isin(held_buckets))


def positional_slice(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows at positions first..last-1 of a stated (total) order.

    Rows are dealt to ranges of the order and numbered inside each; ranges that lie
    outside the slice are dropped by their sizes alone, so no task reads the prefix.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", "_size", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    wanted = before.where((F.col("_before") < last) & (F.col("_before") + F.col("_size") > first)).select("_part", "_before")
    position = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (ranged.join(wanted, "_part").withColumn("_at", position)
            .where((F.col("_at") >= first) & (F.col("_at") < last)).drop("_part", "_before", "_at"))
