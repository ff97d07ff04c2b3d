"""As-of lookups and forward fills on daily series.

The right side holds one row per key and date. The left side may be of any
size and skew: only its distinct (key, date) pairs enter the window, so a
window group never exceeds two calendars' worth of rows; the answer returns to
the left rows by an equi-join, which adaptive execution can split when skewed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_lookup(left: DataFrame, right: DataFrame, key: list[str], left_date: str,
                right_date: str, values: list[str], *, strict: bool,
                stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Attach ``values`` of the last right row before (strict) or at ``left_date``.

    The last *row* is taken even where its values are null. ``stage`` writes the
    answers first, so that the join back is planned by their real size: those of a
    few keys are broadcast, and the left rows stay where they are.
    """
    probes = (left.select(*key, F.col(left_date).alias("_d")).where(F.col("_d").isNotNull())
              .distinct())
    carried = F.struct(*values)
    known = right.select(*key, F.col(right_date).alias("_d"), carried.alias("_v"),
                         F.lit(1).alias("_side"))
    asked = probes.select(*key, "_d", F.lit(None).cast(known.schema["_v"].dataType).alias("_v"),
                          F.lit(0 if strict else 2).alias("_side"))
    w = (Window.partitionBy(*key).orderBy("_d", "_side")
         .rowsBetween(Window.unboundedPreceding, 0))
    answers = (known.unionByName(asked)
               .withColumn("_hit", F.last("_v", ignorenulls=True).over(w))
               .where(F.col("_side") != 1)
               .select(*key, F.col("_d").alias(left_date),
                       *[F.col(f"_hit.{v}").alias(v) for v in values]))
    return left.join(stage(answers) if stage else answers, [*key, left_date], "left")


def filled_grid(prices: DataFrame, trading_days: DataFrame, key: str, values: list[str],
                date: str = "date") -> DataFrame:
    """Every trading day of every key, values carried forward.

    Rows off the calendar are dropped first. Each price row is expanded over
    the days until the key's next row, so the grid needs neither a cross
    product nor a window over itself; days before a key's first row carry
    nulls. ``trading_days`` has (date, seq) with seq counting from 0.
    """
    span = trading_days.agg(F.max("seq")).scalar()
    w = Window.partitionBy(key).orderBy("seq")
    placed = (prices.join(F.broadcast(trading_days), date)
              .select(key, "seq", *values)
              .withColumn("_next", F.lead("seq").over(w))
              .withColumn("_first", F.row_number().over(w) == 1)
              .withColumn("_last", F.coalesce(F.col("_next") - 1, span)))
    expanded = placed.select(
        key, *[F.col(v).alias(f"_{v}") for v in values], F.col("seq").alias("_from"),
        F.explode(F.sequence(F.when(F.col("_first"), F.lit(0)).otherwise(F.col("seq"))
                             .cast("int"), F.col("_last").cast("int"))).alias("seq"))
    held = F.col("seq") >= F.col("_from")
    return (expanded.select(key, "seq", *[F.when(held, F.col(f"_{v}")).alias(v) for v in values])
            .join(F.broadcast(trading_days), "seq"))
