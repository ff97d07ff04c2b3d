"""Ex-ante volatility scale and the normalised training target."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import rolling as R
from eventide.functions import scalars as S
from eventide.operators.asof import asof_lookup
from eventide.operators.ordered import average_rank

ENTITY = "internal_company_id"


@dataclass(frozen=True)
class ScaleRules:
    method: str = "hybrid"          # hybrid | daily | event
    daily_lookback: int = 252
    event_lookback: int = 8
    min_events: int = 4
    daily_weight: float = 0.7
    event_weight: float = 0.3
    low: float = 0.02
    high: float = 1.0


def with_daily_returns(prices: DataFrame, key: str) -> DataFrame:
    return prices.withColumn("log_ret", R.log_diff("adjusted_close", R.series(key, "date")))


def trailing_daily_vol(prices: DataFrame, key: str, lookback: int, min_obs: int,
                       out: str = "daily_vol") -> DataFrame:
    """(key, date, out): std of the last ``lookback`` returns up to and including the row."""
    w = R.series(key, "date")
    vol = R.rolling_std("log_ret", w, lookback, min_obs)
    return (with_daily_returns(prices, key)
            .select(key, "date", F.when(vol > 0, vol).alias(out)))


def with_event_vol(samples: DataFrame, lookback: int, min_events: int) -> DataFrame:
    """Robust spread of the entity's previous event returns.

    1.4826 x median absolute deviation of up to ``lookback`` prior returns; the
    sample deviation when the MAD is zero; null with too few events.
    """
    w = R.series(ENTITY, ["entry_date", "sample_id"]).rowsBetween(-lookback, -1)
    past = F.col("_past")
    with_past = samples.withColumn("_past", F.collect_list("raw_log_return").over(w))
    with_mid = with_past.withColumn("_mid", R.sorted_median(past))
    mad = R.sorted_median(F.transform(past, lambda x: F.abs(x - F.col("_mid"))))
    n = F.size(past)
    mean = F.aggregate(past, F.lit(0.0), lambda a, x: a + x) / n
    square = F.aggregate(past, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    std = F.sqrt(square / F.nullif(n - 1, F.lit(0)))
    robust = F.when(mad > 0, mad * S.MAD_TO_SIGMA).otherwise(F.when(std > 0, std))
    return (with_mid.withColumn("event_vol", F.when(n >= min_events, robust))
            .drop("_past", "_mid"))


def with_ex_ante_scale(samples: DataFrame, prices: DataFrame, key: str = ENTITY,
                       rules: ScaleRules = ScaleRules(),
                       stage: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Add daily_vol, event_vol, ex_ante_scale, standardized_movement, is_extreme_target_event."""
    vols = trailing_daily_vol(prices, key, rules.daily_lookback, rules.daily_lookback // 2)
    out = asof_lookup(samples, vols, [key], "entry_date", "date", ["daily_vol"], strict=True, stage=stage)
    out = with_event_vol(out, rules.event_lookback, rules.min_events)
    daily = F.col("daily_vol") * F.sqrt(F.greatest(F.col("holding_days"), F.lit(1)))
    event = F.col("event_vol")
    blend = daily * rules.daily_weight + event * rules.event_weight
    if rules.method == "daily":
        scale = daily
    elif rules.method == "event":
        scale = F.coalesce(event, daily)
    else:
        scale = F.coalesce(blend, daily, event)
    scale = S.clip(F.when(scale > 0, scale), rules.low, rules.high)
    return (out.withColumn("ex_ante_scale", scale)
            .withColumn("standardized_movement", F.col("raw_log_return") / F.col("ex_ante_scale"))
            .withColumn("is_extreme_target_event", F.coalesce(
                F.abs("raw_log_return") > F.col("ex_ante_scale") * 3.0, F.lit(False))))


def with_target(samples: DataFrame, mode: str = "tanh_scaled", k: float = 2.5,
                cohort: str = "quarter", sector: str = "sector") -> DataFrame:
    """Add target_normalized_signal in [-1, 1]; rows without a scale lose eligibility.

    Modes: ``tanh_scaled``; ``cross_sectional_rank`` and ``sector_neutral_rank``
    rank the return within the entry quarter (and sector).
    """
    valid = F.coalesce(F.col("ex_ante_scale") > 0, F.lit(False))
    if mode == "tanh_scaled":
        out = samples.withColumn("target_normalized_signal",
                                 S.tanh_target("raw_log_return", "ex_ante_scale", k))
    else:
        by = ["_cohort"]
        staged = (samples.withColumn("_cohort", F.date_trunc(cohort, F.col("entry_date")))
                  .withColumn("_r", F.when(valid, F.col("raw_log_return"))))
        if mode == "sector_neutral_rank":
            by.append("_sector")
            staged = staged.withColumn("_sector", F.coalesce(F.col(sector), F.lit("UNK")))
        ranked = average_rank(staged, by, "_r", "_pct")
        out = (ranked.withColumn("target_normalized_signal",
                                 S.clip(F.col("_pct") * 2.0 - 1.0, -1.0, 1.0))
               .drop("_r", "_pct", *by))
    reason = (F.col("exclusion_reason") if "exclusion_reason" in samples.columns
              else F.lit(None).cast("string"))
    return (out.withColumn("exclusion_reason",
                           F.coalesce(F.nullif(reason, F.lit("")),
                                      F.when(~valid, "missing_ex_ante_scale")))
            .withColumn("eligible_for_training", F.col("eligible_for_training") & valid))


def frequency_weights(samples: DataFrame, by_entity: bool = True,
                      by_quarter: bool = True) -> DataFrame:
    """Inverse-frequency sample weights, scaled to mean one.

    Frequencies come from grouped counts joined back, not from windows, so a
    hot entity or quarter is never gathered.
    """
    weighted = (samples.withColumn("_q", F.date_trunc("quarter", F.col("entry_date")))
                .withColumn("_w", F.lit(1.0)))
    for wanted, col in ((by_entity, ENTITY), (by_quarter, "_q")):
        if wanted:
            freq = weighted.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
            weighted = (weighted.join(freq, col).withColumn("_w", F.col("_w") / F.col("_n"))
                        .drop("_n"))
    mean = weighted.agg(F.avg("_w")).scalar()
    return weighted.withColumn("sample_weight", F.col("_w") / mean).drop("_w", "_q")


def rank_labels(samples: DataFrame, grades: int = 31) -> DataFrame:
    """Graded relevance 0..grades-1 by rank of return within the entry quarter."""
    staged = samples.withColumn("quarter", S.quarter_label("entry_date"))
    ranked = average_rank(staged, ["quarter"], "raw_log_return", "_pct")
    # The top rank must stay inside the last grade.
    grade = F.floor(F.col("_pct") * (grades - 0.001))
    return ranked.withColumn("relevance", F.least(grade, F.lit(grades - 1)).cast("int")).drop("_pct")


def group_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("quarter").agg(F.count(F.lit(1)).alias("group_size"))


def time_quartiles(samples: DataFrame, out: str = "time_quartile") -> DataFrame:
    """Quartile 1..4 by entry date from the exact ordered counts of dates."""
    from eventide.operators.ordered import ordered_counts
    staged = samples.withColumn("_d", F.datediff("entry_date", F.lit("1970-01-01").cast("date"))
                                .cast("double"))
    place = ordered_counts(staged, [], "_d").select(
        "_d", F.least(F.floor(F.col("below") * 4 / F.col("total")) + 1, F.lit(4))
        .cast("int").alias(out))
    return staged.join(place, "_d").drop("_d")


def reward_weights(df: DataFrame, signal: str, ret: str, scale: float = 8.0) -> DataFrame:
    """exp(scale x reward) normalised to mean one; reward = agreement x confidence x |return|."""
    agree = F.signum(signal) * F.signum(ret)
    reward = agree * F.abs(signal) * F.abs(ret)
    raw = df.withColumn("_w", F.exp(reward * scale))
    return raw.withColumn("reward_weight", F.col("_w") / raw.agg(F.avg("_w")).scalar()).drop("_w")
