"""Performance summaries, drawdowns, concentration and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import rolling as R
from eventide.operators.candidates import ENTITY

YEAR = 252


def with_drawdown(returns: DataFrame, ret: str, by: list[str], order: str = "date") -> DataFrame:
    """Add equity (running product) and drawdown from its running maximum."""
    w = R.series(by, order)
    ahead = w.rowsBetween(Window.unboundedPreceding, 0)
    return (returns.withColumn("equity", R.compounded(ret, w))
            .withColumn("drawdown", F.col("equity") / F.max("equity").over(ahead) - 1.0))


def performance_summary(returns: DataFrame, by: list[str], ret: str = "ret",
                        turnover: str | None = None) -> DataFrame:
    """One row per portfolio: annual return and volatility, Sharpe, Sortino, drawdown, Calmar."""
    path = with_drawdown(returns, ret, by)
    r = F.col(ret)
    n = F.count(F.lit(1))
    annual = F.exp(F.sum(F.log1p(r)) * F.lit(YEAR) / n) - 1.0
    vol = F.coalesce(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))
    down = F.coalesce(F.stddev_samp(F.least(r, F.lit(0.0))), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))
    deepest = F.min("drawdown")
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    aggs = [annual.alias("annualized_return"), vol.alias("annualized_volatility"),
            down.alias("_down"), deepest.alias("max_drawdown"), n.alias("n_days")]
    if turnover:
        aggs.append((F.avg(turnover) * YEAR).alias("annualized_turnover"))
    out = path.groupBy(*by).agg(*aggs)
    ar = F.col("annualized_return")
    return (out.withColumn("sharpe", ratio(ar, F.col("annualized_volatility")))
            .withColumn("sortino", ratio(ar, F.col("_down")))
            .withColumn("calmar", ratio(ar, F.abs("max_drawdown"))).drop("_down"))


def drawdown_episodes(returns: DataFrame, ret: str, by: list[str], noise: float = 1e-9) -> DataFrame:
    """Peak, trough, recovery, depth and durations of every drawdown below the running high.

    An episode starts at a high and lasts until the next one; it is numbered by
    the highs seen so far. A day within ``noise`` of the high, the size of rounding in
    compounded returns, is at the high.
    """
    w = R.series(by, "date")
    path = with_drawdown(returns, ret, by).withColumn(
        "_ep", F.sum(F.when(F.col("drawdown") >= -noise, 1).otherwise(0)).over(w))
    path = path.withColumn("_next", F.lead("date").over(w))
    below = F.col("drawdown") < -noise
    out = path.groupBy(*by, "_ep").agg(
        F.min(F.when(~below, F.col("date"))).alias("peak_date"),
        F.min_by("date", "drawdown").alias("trough_date"), F.min("drawdown").alias("depth"),
        F.max_by(F.struct(F.col("_next").alias("d")), "date").alias("_end"),
        F.count(F.when(below, 1)).alias("days_below"))
    return (out.where(F.col("depth") < -noise)
            .select(*by, F.col("_ep").alias("episode"), "peak_date", "trough_date",
                    F.col("_end.d").alias("recovery_date"), "depth", "days_below"))


def rolling_excess(returns: DataFrame, ret: str, benchmark: str, by: list[str],
                   window: int = YEAR) -> DataFrame:
    """Compounded return over the window minus the benchmark's; null until the window is full."""
    w = R.series(by, "date")
    frame = (-(window - 1), 0)
    full = F.count(F.lit(1)).over(w.rowsBetween(*frame)) == window
    excess = R.compounded(ret, w, frame) - R.compounded(benchmark, w, frame)
    return returns.withColumn("rolling_excess", F.when(full, excess))


def monthly_hit_rate(returns: DataFrame, ret: str, benchmark: str, by: list[str]) -> DataFrame:
    """Share of months in which the compounded return beats the benchmark's."""
    total = lambda c: F.exp(F.sum(F.log1p(c)))
    months = (returns.withColumn("_m", F.trunc("date", "month")).groupBy(*by, "_m")
              .agg(total(ret).alias("_a"), total(benchmark).alias("_b")))
    return months.groupBy(*by).agg(F.avg((F.col("_a") > F.col("_b")).cast("int")).alias("hit_rate"),
                                   F.count(F.lit(1)).alias("months"))


def concentration(holdings: DataFrame) -> DataFrame:
    """Herfindahl index, top-5 and top-10 share and count per day."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.col("weight").desc(), ENTITY))
    top = lambda k: F.sum(F.when(F.col("_k") <= k, F.col("weight")))
    return (holdings.withColumn("_k", rank).groupBy("date")
            .agg(F.sum(F.col("weight") * F.col("weight")).alias("herfindahl"),
                 top(5).alias("top5_weight"), top(10).alias("top10_weight"),
                 F.count(F.lit(1)).alias("n_positions")))


def daily_contributions(holdings: DataFrame, returns: DataFrame, days: DataFrame,
                        key: str = ENTITY) -> DataFrame:
    """(date, entity, contribution): the previous trading day's weight times the day's return.

    ``returns`` has (key, seq, ret); ``holdings`` carries ``key`` and ``seq``.
    """
    before = holdings.withColumn("seq", F.col("seq") + 1)
    return (before.join(returns.select(key, "seq", "ret"), [key, "seq"])
            .drop("date").join(F.broadcast(days), "seq")
            .withColumn("contribution", F.col("weight") * F.col("ret")))


def top_contributors(contributions: DataFrame, n: int = 20) -> DataFrame:
    return (contributions.groupBy(ENTITY).agg(F.sum("contribution").alias("total_contribution"))
            .orderBy(F.col("total_contribution").desc(), ENTITY).limit(n))


def contribution_by(contributions: DataFrame, dimensions: list[str]) -> DataFrame:
    """Contribution totals per single dimension and overall, in one pass over grouping sets."""
    sets = [[F.col(d)] for d in dimensions] + [[]]
    named = contributions.select("contribution", *dimensions)
    level = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dimensions], F.lit("total"))
    member = F.coalesce(*[F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dimensions],
                        F.lit("all"))
    return (named.groupingSets(sets, *dimensions)
            .agg(F.sum("contribution").alias("total_contribution"), level.alias("dimension"),
                 member.alias("member"))
            .select("dimension", "member", "total_contribution"))


def dollar_volume_exposure(holdings: DataFrame, prices: DataFrame, key: str = ENTITY,
                           lookback: int = 60) -> DataFrame:
    """Weighted trailing dollar volume of held names per day; days without quotes drop out."""
    from eventide.operators.universe import with_trailing_dollar_volume
    dv = with_trailing_dollar_volume(prices, key, lookback, lookback // 4, lag=0)
    quoted = prices.select("date").distinct()
    joined = (holdings.join(dv.select(key, "date", "trailing_dv"), [key, "date"], "left")
              .join(quoted, "date", "left_semi"))
    known = F.when(F.col("trailing_dv").isNotNull(), F.col("weight"))
    return joined.groupBy("date").agg(
        F.try_divide(F.sum(F.col("weight") * F.col("trailing_dv")), F.sum(known))
        .alias("weighted_avg_dollar_volume"))


def cash_and_turnover(daily: DataFrame, cost_bps: float, by: list[str]) -> DataFrame:
    turn = F.avg("turnover") * YEAR
    return daily.groupBy(*by).agg(
        F.avg("cash_weight").alias("avg_cash_weight"), F.max("cash_weight").alias("max_cash_weight"),
        F.percentile("cash_weight", F.lit(0.95)).alias("p95_cash_weight"),
        turn.alias("annualized_turnover"),
        (turn * 2.0 * (cost_bps / 10000.0) * 100.0).alias("cost_drag_per_year_pct"))


def decision_label(summary: DataFrame, strategy: str, baseline: str, fallback: str,
                   by: str = "portfolio") -> DataFrame:
    """A, B, C or borderline: the strategy against the baseline on Sharpe, drawdown and return.

    ``fallback`` replaces the baseline when the latter is absent.
    """
    metrics = ["sharpe", "max_drawdown", "annualized_return"]
    def pick(name: str) -> Column:
        return F.max(F.when(F.col(by) == name, F.struct(*metrics)))
    row = summary.agg(pick(strategy).alias("s"),
                      F.coalesce(pick(baseline), pick(fallback)).alias("b"))
    sharper = F.col("s.sharpe") > F.col("b.sharpe")
    shallower = F.abs("s.max_drawdown") <= F.abs("b.max_drawdown")
    richer = F.col("s.annualized_return") > F.col("b.annualized_return")
    label = (F.when(~sharper & ~richer, "A").when(sharper & ~shallower, "B")
             .when(sharper & shallower & richer, "C").otherwise("borderline"))
    return row.select(F.lit(strategy).alias(by), label.alias("decision"))


def robustness_rollup(results: DataFrame, baseline: str) -> DataFrame:
    """Mean metrics per variant over all (universe, seed) runs, and change against each run's baseline."""
    base = (results.where(F.col("variant") == baseline)
            .select("universe", "seed", *[F.col(m).alias(f"_{m}")
                                          for m in ("sharpe", "max_drawdown", "calmar")]))
    change = lambda m: (F.try_divide(F.col(m), F.col(f"_{m}")) - 1.0) * 100.0
    joined = results.join(base, ["universe", "seed"])
    return (joined.rollup("variant", "universe")
            .agg(*[F.avg(m).alias(f"mean_{m}") for m in ("sharpe", "max_drawdown", "calmar")],
                 *[F.avg(change(m)).alias(f"change_{m}_pct")
                   for m in ("sharpe", "max_drawdown", "calmar")],
                 F.count(F.lit(1)).alias("runs"))
            .where(F.col("variant").isNotNull()))
