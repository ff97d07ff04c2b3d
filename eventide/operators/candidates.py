"""Which predictions are live on each trading day, and which compete for weight.

Everything is computed for all days at once. Predictions become disjoint intervals of trading
days per entity; lists of a day's best come from the intervals (``interval_top``), and only
answers that have a row per day and entity expand them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import rolling as R
from eventide.functions import scalars as S
from eventide.operators import interval_top as IT
from eventide.operators.scale_target import with_daily_returns

ENTITY = "internal_company_id"


@dataclass(frozen=True)
class PortfolioRules:
    min_signal: float = 0.05
    signal_power: float = 1.0
    target_positions: int = 50
    max_positions: int = 100
    max_weight: float = 0.05
    min_weight: float = 0.0025
    allow_cash: bool = True
    leverage: float = 1.0
    max_sector_weight: float | None = None


@dataclass(frozen=True)
class RiskRules:
    lookback: int = 252
    min_obs: int = 63
    low: float = 0.005
    high: float = 0.10


def active_on(predictions: DataFrame, as_of: str) -> DataFrame:
    """Predictions whose entry-to-exit interval covers one day, ends included."""
    return predictions.where(F.lit(as_of).cast("date").between(F.col("entry_date"),
                                                               F.col("exit_date")))


def active_pieces(predictions: DataFrame, calendar: DataFrame, days: DataFrame) -> DataFrame:
    """Predictions with the day numbers (_a to _b) on which each is its entity's latest active one.

    A row per run of such days.     Almost always an entity's intervals follow each other or overlap in order;
    then each is simply cut where the next begins. Only entities with an
    interval inside an older one need the per-day comparison.
    """
    dated = predictions.where(F.col("entry_date").isNotNull() & F.col("exit_date").isNotNull())
    w = R.series(ENTITY, ["entry_date", "sample_id"])
    older = F.max("exit_date").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = (dated.withColumn("_nested", F.coalesce(older > F.col("exit_date"), F.lit(False)))
               .withColumn("_nested", F.max("_nested").over(Window.partitionBy(ENTITY)))
               .withColumn("_until", F.least("exit_date", F.date_sub(F.lead("entry_date").over(w), 1))))
    plain = flagged.where(~F.col("_nested")).drop("_nested")
    nested = flagged.where("_nested").drop("_nested").withColumn("_until", F.col("exit_date"))
    cols = [c for c in predictions.columns if c != ENTITY]
    latest = F.max_by(F.struct(*cols), F.struct("entry_date", "sample_id"))
    per_day = (_numbered(nested, calendar, days).withColumn("seq", F.explode(F.sequence(IT.FIRST, IT.LAST)))
               .groupBy("seq", ENTITY).agg(latest.alias("_p")))
    place = F.row_number().over(Window.partitionBy(ENTITY, "_p.sample_id").orderBy("seq"))
    resolved = (per_day.withColumn("_run", F.col("seq") - place).groupBy(ENTITY, "_p.sample_id", "_run")
                .agg(F.first("_p").alias("_p"), F.min("seq").alias(IT.FIRST), F.max("seq").alias(IT.LAST))
                .select(ENTITY, "_p.*", IT.FIRST, IT.LAST))
    return _numbered(plain, calendar, days).unionByName(resolved)


def active_by_day(predictions: DataFrame, calendar: DataFrame, days: DataFrame) -> DataFrame:
    """One row per trading day and entity: the latest prediction active that day."""
    expanded = active_pieces(predictions, calendar, days).withColumn(
        "seq", F.explode(F.sequence(IT.FIRST, IT.LAST))).drop(IT.FIRST, IT.LAST)
    return with_dates(expanded, days)


def with_dates(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows with the date of their day number, as ``as_of``."""
    return rows.join(F.broadcast(days.select("seq", F.col("date").alias("as_of"))), "seq")


def day_numbers(calendar: DataFrame, days: DataFrame) -> DataFrame:
    """Per calendar date: numbers of the last trading day at or before and the first at or after."""
    hit = calendar.select("date").join(days.select("date", "seq"), "date", "left")
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    before = F.coalesce(F.max("seq").over(w), F.lit(-1))
    return hit.select("date", before.alias("before"), F.coalesce("seq", before + 1).alias("after"))


def _numbered(intervals: DataFrame, calendar: DataFrame, days: DataFrame) -> DataFrame:
    """Intervals from entry_date to _until as day numbers; those without a trading day drop out."""
    span = calendar.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    numbers = day_numbers(calendar, days)
    start = numbers.select(F.col("date").alias("_start"), F.col("after").alias("_a"))
    stop = numbers.select(F.col("date").alias("_stop"), F.col("before").alias("_b"))
    clipped = (intervals.withColumn("_start", F.greatest("entry_date", span["lo"]))
               .withColumn("_stop", F.least("_until", span["hi"])))
    return (clipped.join(F.broadcast(start), "_start").join(F.broadcast(stop), "_stop")
            .where(F.col(IT.FIRST) <= F.col(IT.LAST)).drop("_start", "_stop", "_until"))


def risk_vol_by_day(prices: DataFrame, calendar: DataFrame, days: DataFrame, key: str,
                    rules: RiskRules = RiskRules()) -> DataFrame:
    """(key, seq, vol_estimate): trailing volatility known strictly before each trading day."""
    w = R.series(key, "date")
    vol = R.rolling_std("log_ret", w, rules.lookback, rules.min_obs)
    rows = (with_daily_returns(prices, key)
            .select(key, "date", S.clip(F.when(vol > 0, vol), rules.low, rules.high)
                    .alias("vol_estimate")))
    return hold_until_next(rows, calendar, days, key, ["vol_estimate"])


def hold_until_next(rows: DataFrame, calendar: DataFrame, days: DataFrame, key: str,
                    values: list[str]) -> DataFrame:
    """Spread each dated row over the trading days after it, up to and including the next row's date."""
    last = days.agg(F.max("seq")).scalar()
    seqs = day_numbers(calendar, days).select("date", F.col("before").alias("_s"))
    placed = (rows.join(F.broadcast(seqs), "date")
              .withColumn("_to", F.coalesce(F.lead("_s").over(R.series(key, "date")), last)))
    return (placed.where(F.col("_to") > F.col("_s"))
            .select(key, *values, F.explode(F.sequence(F.col("_s") + 1, F.col("_to")))
                    .alias("seq")))


def with_risk(active: DataFrame, vols: DataFrame, key: str) -> DataFrame:
    """Attach the day's volatility; rows without one cannot be sized and drop out."""
    return active.join(vols.where(F.col("vol_estimate").isNotNull()), [key, "seq"])


def _positive(rows: DataFrame, rules: PortfolioRules) -> DataFrame:
    return (rows.where(F.col("predicted_signal").isNotNull())
            .withColumn("positive_signal", F.greatest("predicted_signal", F.lit(0.0)))
            .where(F.col("positive_signal") >= rules.min_signal))


def _sized(rows: DataFrame, vols: DataFrame, key: str, days: DataFrame, by: str, rules: PortfolioRules) -> DataFrame:
    """The first ``max_positions`` of each day by a column, among those with a volatility that day."""
    known = vols.where(F.col("vol_estimate").isNotNull())
    top = IT.top_by_day(IT.within(rows, IT.spans(known, key), key), days.agg(F.max("seq")).first()[0] or 0,
                        lambda: [F.col(by).desc(), F.col(ENTITY)], rules.max_positions, "signal_rank", lead=by)
    return with_dates(top.join(known, [key, "seq"]), days)


def candidates_by_day(pieces: DataFrame, vols: DataFrame, key: str, days: DataFrame, rules: PortfolioRules) -> DataFrame:
    """``select_candidates`` of every day from intervals (``active_pieces``), without a row per day and name."""
    return _sized(_positive(pieces, rules), vols, key, days, "positive_signal", rules)


def distribution_candidates_by_day(pieces: DataFrame, vols: DataFrame, key: str, days: DataFrame, rules: PortfolioRules, **limits) -> DataFrame:
    """``select_distribution_candidates`` of every day from intervals."""
    return _sized(_confident(pieces, **limits), vols, key, days, "sort_key", rules)


def decayed_candidates_by_day(pieces: DataFrame, vols: DataFrame, key: str, calendar: DataFrame, days: DataFrame,
                              rules: PortfolioRules, *, tau: float = 63.0, floor: float = 0.10, max_age: int = 252) -> DataFrame:
    """``select_candidates`` over ``with_decayed_signal`` of every day, from intervals.

    While signals decay, all do so at one rate, so signal times exp(entry / tau) ranks them alike
    on every day; from the age at which the factor stays, the signal itself does. An interval is
    cut at that age, and each of the two kinds has lists of its own.
    """
    steady = max_age if floor <= 0 else max(0, min(max_age, math.ceil(-tau * math.log(min(floor, 1.0)))))
    span = calendar.agg(F.struct(F.min("date").alias("lo"), F.max("date").alias("hi"))).scalar()
    cuts = day_numbers(calendar, days).select(F.col("date").alias("_at"), F.col("after").alias("_cut"))
    known = vols.where(F.col("vol_estimate").isNotNull())
    rows = (IT.within(_positive(pieces, rules).drop("positive_signal"), IT.spans(known, key), key)
            .withColumn("_at", F.greatest(F.date_add("entry_date", steady), span["lo"]))
            .join(F.broadcast(cuts), "_at", "left").withColumn("_cut", F.coalesce("_cut", F.col(IT.LAST) + 1)))
    base = F.greatest("predicted_signal", F.lit(0.0))
    grown = F.log(base) + F.datediff("entry_date", F.lit("2000-01-01").cast("date")) / F.lit(tau)
    decaying = (rows.withColumn(IT.LAST, F.least(F.col(IT.LAST), F.col("_cut") - 1))
                .withColumn("_kind", F.lit(0)).withColumn("_by", grown))
    settled = rows.withColumn(IT.FIRST, F.greatest(IT.FIRST, "_cut")).withColumn("_kind", F.lit(1)).withColumn("_by", base)
    split = decaying.unionByName(settled).where(F.col(IT.FIRST) <= F.col(IT.LAST)).drop("_at", "_cut")

    def daily(df: DataFrame) -> DataFrame:
        return _positive(with_decayed_signal(with_dates(df, days), tau=tau, floor=floor, max_age=max_age), rules)

    top = IT.top_by_day(split, days.agg(F.max("seq")).first()[0] or 0, lambda: [F.col("_by").desc(), F.col(ENTITY)],
                        rules.max_positions, "signal_rank", kinds=["_kind"], spare=16, daily=daily,
                        day_order=lambda: [F.col("positive_signal").desc(), F.col(ENTITY)])
    return top.drop("_by").join(known, [key, "seq"])


def select_candidates(active: DataFrame, rules: PortfolioRules) -> DataFrame:
    """Positive signals above the threshold, the strongest ``max_positions`` per day.

    The rank filter is a group limit: each task keeps its own top rows before
    the shuffle, so a crowded day never moves whole.
    """
    w = Window.partitionBy("as_of").orderBy(F.col("positive_signal").desc(), ENTITY)
    return (_positive(active, rules).withColumn("signal_rank", F.row_number().over(w))
            .where(F.col("signal_rank") <= rules.max_positions))


def _confident(rows: DataFrame, min_probability: float = 0.55, std_floor: float = 0.05) -> DataFrame:
    std = F.greatest("predicted_signal_std", F.lit(std_floor))
    return (rows.dropna(subset=["predicted_signal", "probability_positive",
                                  "predicted_signal_std"])
            .where(F.col("probability_positive") >= min_probability)
            .withColumn("positive_signal", F.greatest("predicted_signal", F.lit(0.0)))
            .withColumn("confidence", F.greatest(F.col("probability_positive") - 0.5, F.lit(0.0)))
            .withColumn("floored_std", std)
            .withColumn("sort_key", F.col("confidence") / std))


def select_distribution_candidates(active: DataFrame, rules: PortfolioRules, *,
                                   min_probability: float = 0.55,
                                   std_floor: float = 0.05) -> DataFrame:
    """Candidates by probability of a gain, ranked by confidence over predicted spread."""
    w = Window.partitionBy("as_of").orderBy(F.col("sort_key").desc(), ENTITY)
    return (_confident(active, min_probability, std_floor)
            .withColumn("signal_rank", F.row_number().over(w))
            .where(F.col("signal_rank") <= rules.max_positions))


def with_decayed_signal(active: DataFrame, *, tau: float = 63.0, mode: str = "exponential",
                        floor: float = 0.10, max_age: int = 252) -> DataFrame:
    """Scale the signal by its age in days at ``as_of``, never below ``floor``."""
    age = F.least(F.greatest(F.datediff("as_of", "entry_date"), F.lit(0)), F.lit(max_age))
    factor = (F.lit(1.0) - age / tau * (1.0 - floor) if mode == "linear" else F.exp(-age / tau))
    return (active.withColumn("age_days", age)
            .withColumn("decay_factor", S.clip(factor, floor, 1.0))
            .withColumn("predicted_signal", F.col("predicted_signal") * F.col("decay_factor")))
