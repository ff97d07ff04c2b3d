"""Portfolio accounting as joins and windows over days, without a day loop.

Between two rebalances the drift of a portfolio has a closed form: a name's
weight is its start weight times its growth, over the growth of the whole.
So each rebalance is expanded over the days until the next one and everything
else is a grouped sum. The exchange of old for new weights on a rebalance day
uses that day's drifted weights; new weights earn from the next day on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from eventide.operators.candidates import ENTITY


def in_time() -> WindowSpec:
    return Window.partitionBy(F.lit(0)).orderBy("seq")


def trigger_days(predictions: DataFrame, days: DataFrame) -> DataFrame:
    """Trading days on which any prediction starts or ends."""
    dates = (predictions.select(F.col("entry_date").alias("date"))
             .union(predictions.select(F.col("exit_date").alias("date"))).distinct())
    return days.join(dates, "date", "left_semi")


def rebalance_days(predictions: DataFrame, targets: DataFrame, days: DataFrame) -> DataFrame:
    """(date, seq, next_seq): trigger days, plus the first day a portfolio left empty can be filled."""
    trig = trigger_days(predictions, days).select("seq", F.lit(True).alias("_trigger"))
    filled = targets.select("seq").distinct().withColumn("_filled", F.lit(True))
    marked = (days.join(trig, "seq", "left").join(filled, "seq", "left")
              .withColumn("_trigger", F.coalesce("_trigger", F.lit(False)))
              .withColumn("_filled", F.coalesce("_filled", F.lit(False))))
    segment = F.sum(F.col("_trigger").cast("int")).over(in_time())
    within = Window.partitionBy("_seg").orderBy("seq")
    earlier = F.sum(F.col("_filled").cast("int")).over(
        within.rowsBetween(Window.unboundedPreceding, -1))
    first_fill = F.col("_filled") & (F.coalesce(earlier, F.lit(0)) == 0)
    return (marked.withColumn("_seg", segment).withColumn("_first", first_fill)
            .where(F.col("_trigger") | F.col("_first"))
            .select("date", "seq", F.lead("seq").over(in_time()).alias("next_seq")))


def drifted_weights(targets: DataFrame, rebalances: DataFrame, grid: DataFrame, days: DataFrame,
                    key: str = ENTITY, cash_return: float = 0.0) -> DataFrame:
    """Weights of each rebalance's portfolio on every day up to and including the next rebalance.

    ``grid`` has forward-filled prices (key, seq, adjusted_close). Columns:
    rebalance ``start_seq``, day ``seq``, entity, ``weight`` after drift, the
    portfolio's ``growth`` since the rebalance and its drifted ``cash``.
    """
    last = days.agg(F.max("seq")).scalar()
    held = (targets.select("seq", ENTITY, key, "weight", "cash_weight") if key != ENTITY
            else targets.select("seq", ENTITY, "weight", "cash_weight"))
    span = rebalances.select("seq", F.coalesce("next_seq", last).alias("_stop"))
    spread = (held.join(F.broadcast(span), "seq").withColumnRenamed("seq", "start_seq")
              .withColumn("seq", F.explode(F.sequence("start_seq", "_stop"))).drop("_stop"))
    price = grid.select(key, "seq", F.col("adjusted_close").alias("_now"))
    base = grid.select(key, F.col("seq").alias("start_seq"), F.col("adjusted_close").alias("_then"))
    grown = (spread.join(price, [key, "seq"], "left").join(base, [key, "start_seq"], "left")
             .withColumn("_g", F.col("weight") * F.coalesce(F.try_divide(F.col("_now"), F.col("_then")),
                                                            F.lit(1.0))))
    # One rebalance's names on one day: at most ``max_positions`` rows.
    group = Window.partitionBy("start_seq", "seq")
    cash = F.col("cash_weight") * F.pow(F.lit(1.0 + cash_return), F.col("seq") - F.col("start_seq"))
    total = F.sum("_g").over(group) + cash
    return grown.select("start_seq", "seq", ENTITY, (F.col("_g") / total).alias("weight"),
                        total.alias("growth"), (cash / total).alias("cash"))


def portfolio_growth(drifted: DataFrame) -> DataFrame:
    """(start_seq, seq, growth, cash, n): one row per rebalance and day."""
    return drifted.groupBy("start_seq", "seq").agg(
        F.max("growth").alias("growth"), F.max("cash").alias("cash"),
        F.count(F.lit(1)).alias("n"))


def trades(targets: DataFrame, drifted: DataFrame, rebalances: DataFrame,
           cost_bps: float = 10.0) -> DataFrame:
    """Per rebalance and name: old and new weight, trade, cost and reason."""
    span = rebalances.select("seq", "date")
    new = targets.join(F.broadcast(span), "seq").select(
        "seq", ENTITY, F.lit(0.0).alias("old_weight"), F.col("weight").alias("new_weight"))
    ends = rebalances.where(F.col("next_seq").isNotNull()).select(
        F.col("seq").alias("start_seq"), F.col("next_seq").alias("seq"))
    old = drifted.join(F.broadcast(ends), ["start_seq", "seq"]).select(
        "seq", ENTITY, F.col("weight").alias("old_weight"), F.lit(0.0).alias("new_weight"))
    moves = (new.unionByName(old).groupBy("seq", ENTITY)
             .agg(F.sum("old_weight").alias("old_weight"), F.sum("new_weight").alias("new_weight"))
             .withColumn("trade_weight", F.col("new_weight") - F.col("old_weight"))
             .where(F.abs("trade_weight") > 1e-9))
    reason = (F.when((F.col("old_weight") > 0) & (F.col("new_weight") > 0), "rebalance")
              .when(F.col("new_weight") > 0, "new_signal").otherwise("exit"))
    return (moves.join(F.broadcast(span), "seq")
            .select("date", "seq", ENTITY, "old_weight", "new_weight", "trade_weight",
                    (F.abs("trade_weight") * (cost_bps / 10000.0)).alias("trade_cost"),
                    reason.alias("reason")))


def holdings(drifted: DataFrame, rebalances: DataFrame, days: DataFrame) -> DataFrame:
    """End-of-day weights (date, entity, weight): drifted, or fresh on a rebalance day."""
    ends = rebalances.select(F.col("seq").alias("start_seq"), "next_seq")
    return (drifted.join(F.broadcast(ends), "start_seq")
            .where(F.col("next_seq").isNull() | (F.col("seq") < F.col("next_seq")))
            .join(F.broadcast(days), "seq").select("date", "seq", ENTITY, "weight"))


def daily_returns(drifted: DataFrame, trade_rows: DataFrame, rebalances: DataFrame,
                  days: DataFrame, initial_value: float = 1.0) -> DataFrame:
    """Gross, cost and net return, value, cash, positions and turnover of every day."""
    growth = portfolio_growth(drifted)
    w = Window.partitionBy("start_seq").orderBy("seq")
    steps = growth.withColumn("_r", F.col("growth") / F.lag("growth").over(w) - 1.0)
    gross = steps.where(F.col("_r").isNotNull()).select("seq", F.col("_r").alias("gross_return"))
    ends = rebalances.select(F.col("seq").alias("start_seq"), "next_seq")
    state = (growth.join(F.broadcast(ends), "start_seq")
             .where(F.col("next_seq").isNull() | (F.col("seq") < F.col("next_seq")))
             .select("seq", F.col("cash").alias("cash_weight"), F.col("n").alias("n_positions")))
    moved = trade_rows.groupBy("seq").agg((F.sum(F.abs("trade_weight")) / 2.0).alias("turnover"),
                                          F.sum("trade_cost").alias("transaction_cost_return"))
    zero = F.lit(0.0)
    out = (days.join(gross, "seq", "left").join(state, "seq", "left").join(moved, "seq", "left")
           .select("date", "seq", F.coalesce("gross_return", zero).alias("gross_return"),
                   F.coalesce("transaction_cost_return", zero).alias("transaction_cost_return"),
                   F.coalesce("cash_weight", F.lit(1.0)).alias("cash_weight"),
                   F.coalesce("n_positions", F.lit(0)).alias("n_positions"),
                   F.coalesce("turnover", zero).alias("turnover")))
    out = out.withColumn("net_return", F.col("gross_return") - F.col("transaction_cost_return"))
    value = F.exp(F.sum(F.log1p("net_return")).over(
        in_time().rowsBetween(Window.unboundedPreceding, 0))) * initial_value
    return out.withColumn("portfolio_value", value)


def account(targets: DataFrame, predictions: DataFrame, grid: DataFrame, days: DataFrame, *,
            key: str = ENTITY, cost_bps: float = 10.0, cash_return: float = 0.0,
            delay: int = 0, stage: Callable[[DataFrame], DataFrame] = lambda df: df,
            ) -> dict[str, DataFrame]:
    """daily, holdings and trades of a portfolio given its target weights per day.

    ``delay`` executes each rebalance that many trading days later. ``stage``
    may write the drifted weights once (``session.materialize``), since all
    three results read them.
    """
    moments = rebalance_days(predictions, targets, days)
    if delay:
        last = days.agg(F.max("seq")).scalar()
        wanted = targets.join(moments.select("seq"), "seq", "left_semi")
        targets = (wanted.withColumn("seq", F.col("seq") + delay)
                   .where(F.col("seq") <= last))
        shifted = (moments.select((F.col("seq") + delay).alias("seq"))
                   .where(F.col("seq") <= last).join(days, "seq"))
        moments = shifted.select("date", "seq", F.lead("seq").over(in_time()).alias("next_seq"))
    moments = stage(moments)
    drift = stage(drifted_weights(targets, moments, grid, days, key, cash_return))
    moves = trades(targets, drift, moments, cost_bps)
    return {"daily": daily_returns(drift, moves, moments, days),
            "holdings": holdings(drift, moments, days), "trades": moves}
