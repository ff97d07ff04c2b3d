"""Exposure scales from past returns, all days at once.

Each scale sees returns up to the day before and is smoothed against its own
past. They are open loop: computed on the unscaled return series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from eventide.functions import rolling as R
from eventide.functions import scalars as S
from eventide.operators import accounting


def in_time() -> WindowSpec:
    return Window.partitionBy(F.lit(0)).orderBy("seq")


def all_before() -> WindowSpec:
    return in_time().rowsBetween(Window.unboundedPreceding, -1)


WARMUP = 20


def _after_warmup(target, n: int = WARMUP, column: str = "net_return"):
    """``target`` once more than ``n`` past returns exist, full exposure before."""
    return F.when(F.count(column).over(all_before()) > n, target).otherwise(F.lit(1.0))


def vol_scale(daily: DataFrame, *, target: float = 0.15, window: int = 60, low: float = 0.2,
              high: float = 1.2, keep: float = 0.7) -> DataFrame:
    """Target over realised annual volatility."""
    vol = F.stddev_samp("net_return").over(in_time().rowsBetween(-window, -1)) * F.sqrt(F.lit(252.0))
    raw = S.clip(F.when(vol > 1e-6, F.lit(target) / vol).otherwise(F.lit(high)), low, high)
    return (daily.withColumn("_x", _after_warmup(raw))
            .withColumn("vol_scale", R.smoothed("_x", in_time(), keep)).drop("_x"))


def drawdown_scale(daily: DataFrame, *, window: int = 252, trigger: float = 0.10,
                   alpha: float = 1.0, floor: float = 0.3, keep: float = 0.5,
                   adaptive: bool = False, vol_window: int = 60, z: float = 2.0,
                   horizon_days: float = 21.0, trigger_low: float = 0.05,
                   trigger_high: float = 0.20) -> DataFrame:
    """Less exposure the further the drawdown exceeds a fixed or volatility-based trigger."""
    staged = daily.withColumn("_e", R.compounded("net_return", in_time()))
    past = in_time().rowsBetween(-window, -1)
    drop = -(F.lag("_e").over(in_time()) / F.max("_e").over(past) - 1.0)
    level = F.lit(trigger)
    if adaptive:
        near = in_time().rowsBetween(-vol_window, -1)
        vol = F.stddev_samp("net_return").over(near)
        level = F.when((F.count("net_return").over(near) >= 10) & (vol > 0), S.clip(
            vol * z * F.sqrt(F.lit(horizon_days)), trigger_low, trigger_high)).otherwise(level)
    raw = F.when(drop <= level, F.lit(1.0)).otherwise(
        F.greatest(F.lit(floor), F.lit(1.0) - F.lit(alpha) * (drop - level) / level))
    return (staged.withColumn("_x", _after_warmup(raw))
            .withColumn("drawdown_scale", R.smoothed("_x", in_time(), keep)).drop("_x", "_e"))


def beta_scale(daily: DataFrame, market: DataFrame, *, window: int = 60, floor: float = 0.3,
               keep: float = 0.5) -> DataFrame:
    """1 / max(1, beta) against the market's returns (date, market_ret)."""
    past = in_time().rowsBetween(-window, -1)
    joined = daily.join(market.select("date", "market_ret"), "date", "left")
    known = F.count("market_ret").over(past)
    spread = F.var_samp("market_ret").over(past)
    paired = F.when(F.col("market_ret").isNotNull(), F.col("net_return"))
    covariance = F.covar_samp(paired, F.col("market_ret")).over(past)
    beta = F.when((known >= max(20, window // 4)) & (spread >= 1e-12),
                  F.try_divide(covariance, spread)).otherwise(F.lit(1.0))
    raw = S.clip(F.lit(1.0) / F.greatest(F.lit(1.0), beta), floor, 1.0)
    return (joined.withColumn("rolling_beta", beta).withColumn("_x", _after_warmup(raw))
            .withColumn("beta_scale", R.smoothed("_x", in_time(), keep)).drop("_x", "market_ret"))


def vol_of_vol_scale(daily: DataFrame, *, sigma_window: int = 20, vov_window: int = 60,
                     keep: float = 0.5) -> DataFrame:
    """Damped by how unusual the volatility of volatility is against all earlier days."""
    staged = (daily.withColumn("_s", R.rolling_std("net_return", in_time(), sigma_window, 5))
              .withColumn("_v", R.rolling_std("_s", in_time(), vov_window, 10)))
    # The newest usable value is yesterday's; its history ends the day before.
    older = in_time().rowsBetween(Window.unboundedPreceding, -2)
    spread = F.stddev_samp("_v").over(older)
    z = (F.lag("_v").over(in_time()) - F.avg("_v").over(older)) / F.when(spread >= 1e-12, spread)
    enough = F.count("_v").over(all_before()) >= 20
    raw = F.coalesce(F.when(enough, S.damping(F.when(z.isNotNull(), z))), F.lit(1.0))
    raw = F.when(z.isNull(), F.lit(1.0)).otherwise(raw)
    return (staged.withColumn("_x", _after_warmup(raw, sigma_window + vov_window + 4))
            .withColumn("vov_scale", R.smoothed("_x", in_time(), keep)).drop("_x", "_s", "_v"))


def cluster_scale(daily: DataFrame, *, sigma_window: int = 60, count_window: int = 60,
                  history: int = 252, keep: float = 0.5) -> DataFrame:
    """Damped when the recent number of large losses is unusual.

    Each day's count uses that day's own sigma, so it is a count over the day's
    trailing array of returns.
    """
    sigma = R.rolling_std("net_return", in_time(), sigma_window, 10)
    recent = F.collect_list("net_return").over(in_time().rowsBetween(-(count_window - 1), 0))
    staged = (daily.withColumn("_s", sigma).withColumn("_r", recent)
              .withColumn("_i", F.row_number().over(in_time())))
    count = F.when((F.col("_i") >= sigma_window + 5) & (F.col("_s") > 0),
                   F.size(F.filter("_r", lambda x: x < -F.col("_s")))).otherwise(F.lit(0))
    staged = staged.withColumn("_c", count.cast("double"))
    older = in_time().rowsBetween(-(history + 1), -2)
    spread = F.stddev_samp("_c").over(older)
    z = (F.lag("_c").over(in_time()) - F.avg("_c").over(older)) / F.when(spread >= 1e-12, spread)
    raw = F.when(z.isNull(), F.lit(1.0)).otherwise(S.damping(z))
    return (staged.withColumn("_x", _after_warmup(raw, history + count_window + 4))
            .withColumn("cluster_scale", R.smoothed("_x", in_time(), keep))
            .drop("_x", "_s", "_r", "_i", "_c"))


def coherence_scale(coherence: DataFrame, *, history: int = 252, keep: float = 0.5) -> DataFrame:
    """(date, coherence_scale): damped when phase coherence is unusually high."""
    known = coherence.where(F.col("coherence").isNotNull())
    z = R.rolling_z("coherence", in_time(), history, 29, exclude_current=True)
    return (known.withColumn("_x", F.when(z.isNull(), F.lit(1.0)).otherwise(S.damping(z)))
            .select("date", R.smoothed("_x", in_time(), keep).alias("coherence_scale")))


def dispersion_scale(dispersion: DataFrame, *, window: int = 252, kt: float = 2.0,
                     floor: float = 0.3, keep: float = 0.5) -> DataFrame:
    """(date, dispersion_scale): less exposure when cross-sectional dispersion is unusually low."""
    z = R.rolling_z("temperature", in_time(), window, 20)
    raw = F.coalesce(S.clip(F.exp(z / kt), floor, 1.0), F.lit(1.0))
    return (dispersion.withColumn("_x", raw)
            .select("date", S.clip(R.smoothed("_x", in_time(), keep, start=None), floor, 1.0)
                    .alias("dispersion_scale")))


def apply_scale(targets: DataFrame, scales: DataFrame, column: str, day: str = "as_of",
                most: float | None = None, borrow: bool = False) -> DataFrame:
    """Scale each day's weights by the latest scale known that day; what is not invested is cash.

    A day before the first scale keeps its weights. ``most`` bounds the scale; without
    it a scale above one levers, as a volatility target allows. ``borrow`` shows what a
    levered day borrows as negative cash, so that weights and cash add up to one. Weights
    are summed per day and joined back, so a day may hold any number of names.
    """
    days = targets.select(day).distinct()
    known = scales.where(F.col(column).isNotNull()).select(F.col("date").alias(day), F.col(column).alias("_scale"))
    latest = F.last("_scale", ignorenulls=True).over(Window.orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    filled = (days.withColumn("_asked", F.lit(True)).join(known, day, "full")
              .withColumn("_scale", latest).where("_asked").select(day, F.coalesce("_scale", F.lit(1.0)).alias("_scale")))
    if most is not None:
        filled = filled.withColumn("_scale", F.least("_scale", F.lit(most)))
    scaled = (targets.drop("cash_weight").join(F.broadcast(filled), day)  # one row per day
              .withColumn("weight", F.col("weight") * F.col("_scale")).drop("_scale"))
    spare = F.lit(1.0) - F.sum("weight")
    cash = scaled.groupBy(day).agg((spare if borrow else F.greatest(F.lit(0.0), spare)).alias("cash_weight"))
    return scaled.join(F.broadcast(cash), day)


def account_scaled(targets: DataFrame, scales: DataFrame, columns: Sequence[str], predictions: DataFrame,
                   grid: DataFrame, days: DataFrame, **account: object) -> dict[str, DataFrame]:
    """A second pass of accounting over target weights times the product of several scales.

    ``scales`` (date, ``columns``) come from the first, unscaled pass; a missing scale
    counts as one. The scaled weights trade, pay costs and hold cash of their own, and a
    levered day borrows at the return of cash. ``account`` goes to ``accounting.account``.
    """
    product = F.lit(1.0)
    for column in columns:
        product = product * F.coalesce(F.col(column), F.lit(1.0))
    scaled = apply_scale(targets, scales.select("date", product.alias("_product")), "_product", borrow=True)
    return accounting.account(scaled, predictions, grid, days, **account)
