"""Portfolio weights for every day at once.

Allocators take the candidates of all days and return ``weight`` rows. The
day windows below hold at most ``max_positions`` rows, because candidate
selection has already cut each day; ``blended_weights``, which weighs every
active name, uses grouped sums and a bounded top list instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from eventide.functions import rolling as R
from eventide.functions import scalars as S
from eventide.operators.candidates import ENTITY, PortfolioRules


def day_window() -> WindowSpec:
    return Window.partitionBy("as_of")
OUT = ["as_of", ENTITY, "weight", "cash_weight"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _normalised(w: Column) -> Column:
    total = F.sum(w).over(day_window())
    return F.when(total > 0, w / total).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(day_window()))


def _fill_level(df: DataFrame, w: str, cap: Column, out: str) -> DataFrame:
    """Add the day's factor f so that min(cap, f * w) keeps the day's total.

    Sort descending; with the first k weights at the cap the rest scale by
    f_k = (total - k * cap) / (total - their sum). The first k whose next weight
    stays within the cap gives f. Null when even all at the cap fall short.
    """
    order = day_window().orderBy(F.col(w).desc(), ENTITY)
    total = F.sum(w).over(day_window())
    ahead = F.coalesce(F.sum(w).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    k = F.row_number().over(order) - 1
    rest = total - ahead
    factor = F.when(rest > 1e-15, (total - k * cap) / rest)
    staged = df.withColumn("_k", k).withColumn("_f", factor)
    fits = F.col(w) * F.col("_f") <= cap + 1e-12
    first = F.min(F.when(fits, F.struct("_k", "_f"))).over(day_window())
    return staged.withColumn(out, first["_f"]).drop("_k", "_f")


def cap_names(df: DataFrame, w: str, cap: float) -> DataFrame:
    """Cap every weight, spreading the excess over the rest in proportion."""
    level = _fill_level(df, w, F.lit(cap), "_level")
    held = F.when(F.col("_level").isNull(), F.when(F.col(w) > 0, F.lit(cap)).otherwise(0.0))
    return (level.withColumn(w, held.otherwise(F.least(F.lit(cap), F.col(w) * F.col("_level"))))
            .drop("_level"))


def cap_sectors(df: DataFrame, w: str, cap: float) -> DataFrame:
    """Cap each sector's share of the day's total; the excess goes to the other sectors."""
    sector = Window.partitionBy("as_of", "sector")
    lead = F.row_number().over(sector.orderBy(ENTITY)) == 1
    staged = (df.withColumn("sector", F.coalesce("sector", F.lit("UNK")))
              .withColumn("_total", F.sum(w).over(day_window()))
              .withColumn("_in", F.sum(w).over(sector))
              .withColumn("_lead", F.when(lead, F.col("_in")).otherwise(0.0)))
    limit = F.col("_total") * cap
    level = _fill_level(staged, "_lead", limit, "_level")
    share = F.when(F.col("_level").isNull(), limit).otherwise(
        F.least(limit, F.col("_in") * F.col("_level")))
    scaled = F.when(F.col("_in") > 0, F.col(w) * share / F.col("_in")).otherwise(0.0)
    return level.withColumn(w, scaled).drop("_total", "_in", "_lead", "_level")


def finish(df: DataFrame, raw: Column, rules: PortfolioRules, *,
           drop_small: bool = True) -> DataFrame:
    """Raw scores to final weights: floor, caps, leverage and the cash that is left."""
    out = df.withColumn("weight", _normalised(raw))
    if drop_small:
        out = out.withColumn("weight", F.when(F.col("weight") < rules.min_weight, 0.0)
                             .otherwise(F.col("weight")))
        total = F.sum("weight").over(day_window())
        out = out.withColumn("weight", F.when(total > 0, F.col("weight") / total)
                             .otherwise(F.col("weight")))
    out = cap_names(out, "weight", rules.max_weight)
    if rules.max_sector_weight is not None and rules.max_sector_weight < 1.0:
        out = cap_names(cap_sectors(out, "weight", rules.max_sector_weight), "weight",
                        rules.max_weight)
    out = _levered(out, rules)
    return out.where(F.col("weight") > 0)


def _levered(df: DataFrame, rules: PortfolioRules) -> DataFrame:
    total = F.sum("weight").over(day_window())
    lev = F.lit(rules.leverage)
    out = df.withColumn("weight", F.when(total > lev, F.col("weight") / total * lev)
                        .otherwise(F.col("weight")))
    if not rules.allow_cash:
        out = cap_names(out.withColumn("weight", F.when(total > 0, F.col("weight") / total * lev)
                                       .otherwise(F.col("weight"))), "weight", rules.max_weight)
    return out.withColumn("cash_weight", F.greatest(F.lit(0.0), lev - F.sum("weight").over(day_window())))


def inverse_vol_weights(candidates: DataFrame, rules: PortfolioRules) -> DataFrame:
    """Signal share over volatility."""
    raw = F.pow("positive_signal", F.lit(rules.signal_power)) / F.col("vol_estimate")
    return finish(candidates, raw, rules)


def distribution_weights(candidates: DataFrame, rules: PortfolioRules, *, power: float = 1.0,
                         signal_blend: float = 0.0) -> DataFrame:
    """Confidence over predicted spread, optionally times signal, over volatility."""
    budget = F.pow("confidence", F.lit(power)) / F.col("floored_std")
    if signal_blend > 0:
        budget = budget * F.pow(F.greatest("positive_signal", F.lit(1e-9)), F.lit(signal_blend))
    return finish(candidates, budget / F.col("vol_estimate"), rules)


def barbell_weights(candidates: DataFrame, rules: PortfolioRules, *, safe: float = 0.8,
                    top_k: int = 5) -> DataFrame:
    """Equal weight on all names plus equal weight on the strongest few."""
    n = F.count(F.lit(1)).over(day_window())
    strong = F.when(F.col("signal_rank") <= top_k, F.lit(1.0 - safe) / F.least(n, F.lit(top_k)))
    return finish(candidates, F.lit(safe) / n + F.coalesce(strong, F.lit(0.0)), rules)


def expected_shortfall(returns: Column, alpha: float = 0.05) -> Column:
    """Mean loss of the worst alpha share of an array of returns; deviation when too short."""
    n = F.size(returns)
    k = F.greatest(F.lit(1), F.floor(n * F.lit(alpha))).cast("int")
    tail = F.slice(F.array_sort(returns), 1, k)
    mean_tail = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / k
    mean = F.aggregate(returns, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    var = (F.aggregate(returns, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
           / F.nullif(n - 1, F.lit(0)))
    return F.when(n < int(1.0 / alpha), F.coalesce(F.sqrt(var), F.lit(0.0))).otherwise(-mean_tail)


def tail_risk_by_day(prices: DataFrame, calendar: DataFrame, days: DataFrame, key: str, *,
                     lookback: int = 252, min_obs: int = 40, alpha: float = 0.05) -> DataFrame:
    """(key, seq, es): expected shortfall of returns strictly before each trading day."""
    from eventide.operators.candidates import hold_until_next
    from eventide.operators.scale_target import with_daily_returns
    w = R.series(key, "date")
    recent = F.collect_list("log_ret").over(w.rowsBetween(-(lookback - 1), 0))
    rows = (with_daily_returns(prices, key).withColumn("_r", recent)
            .select(key, "date", F.when(F.size("_r") >= min_obs, expected_shortfall(
                F.col("_r"), alpha)).alias("es")))
    return hold_until_next(rows, calendar, days, key, ["es"])


def tail_aware_weights(candidates: DataFrame, tail_risk: DataFrame, key: str,
                       rules: PortfolioRules) -> DataFrame:
    """Signal over expected shortfall; a day with any unknown shortfall uses inverse volatility."""
    known = candidates.join(tail_risk, [key, "seq"], "left")
    signal = F.pow("positive_signal", F.lit(rules.signal_power))
    unknown = F.max(F.col("es").isNull()).over(day_window())
    raw = F.when(unknown, signal / F.col("vol_estimate")).otherwise(
        signal / F.greatest("es", F.lit(1e-9)))
    return finish(known, raw, rules)


def saturated(df: DataFrame, signal: str, out: str, by: list[str] | None = None) -> DataFrame:
    """s / (K + s) with K the group's median positive signal."""
    w = Window.partitionBy(*(by or ["as_of"]))
    s = F.greatest(F.col(signal), F.lit(0.0))
    half = F.coalesce(F.percentile(F.when(s > 1e-9, s), F.lit(0.5)).over(w), F.lit(1e-6))
    return df.withColumn(out, s / (F.greatest(half, F.lit(1e-9)) + s))


def shrunk(df: DataFrame, signal: str, out: str, noise_var: float | None = None,
           by: list[str] | None = None) -> DataFrame:
    """James-Stein shrinkage of the group's signals towards their mean.

    Without ``noise_var`` the noise is the group variance over n, which shrinks
    only slightly.
    """
    w = Window.partitionBy(*(by or ["as_of"]))
    s = F.col(signal)
    n, mean, var = F.count(s).over(w), F.avg(s).over(w), F.var_samp(s).over(w)
    square = var * (n - 1)
    noise = F.lit(noise_var) if noise_var is not None else var / n
    c = S.clip((n - 2) * noise / F.nullif(square, F.lit(0.0)), 0.0, 1.0)
    usable = (n >= 3) & (square > 1e-12) & (noise > 0)
    return df.withColumn(out, F.when(usable, mean + (F.lit(1.0) - c) * (s - mean)).otherwise(s))


def signal_entropy(df: DataFrame, signal: str = "positive_signal", low: float = 2.0,
                   high: float = 10.0) -> DataFrame:
    """Per day: entropy of the signal shares and the risk aversion it implies."""
    share = F.col(signal) / F.nullif(F.sum(signal).over(day_window()), F.lit(0.0))
    term = F.when(share > 1e-12, -share * F.log(share)).otherwise(0.0)
    per = (df.withColumn("_t", term).groupBy("as_of")
           .agg(F.sum("_t").alias("entropy"), F.count(F.lit(1)).alias("n")))
    level = S.clip(F.col("entropy") / F.nullif(F.log("n"), F.lit(0.0)), 0.0, 1.0)
    gamma = F.when(F.col("n") <= 1, F.lit(high)).otherwise(F.lit(low) + level * (high - low))
    return per.withColumn("risk_aversion", gamma)


def ensemble_weights(first: DataFrame, second: DataFrame, rules: PortfolioRules,
                     alpha: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """alpha * first + (1 - alpha) * second per name, then the usual finish."""
    carry = carry or []
    keys = ["as_of", ENTITY, *carry]
    both = (first.select(*keys, (F.col("weight") * alpha).alias("_w"))
            .unionByName(second.select(*keys, (F.col("weight") * (1 - alpha)).alias("_w")))
            .groupBy("as_of", ENTITY)
            .agg(F.sum("_w").alias("_w"), *[F.max(c).alias(c) for c in carry]))
    return finish(both, F.col("_w"), rules)


def max_entropy_weights(candidates: DataFrame, rules: PortfolioRules, *, vol_blend: float = 0.5,
                        rounds: int = 40, tolerance: float = 0.5,
                        top: float = 200.0) -> DataFrame:
    """Softmax of the vol-adjusted signal at the slope giving the wanted effective number.

    The slope of a day is found by bisection folded over the day's bounded
    array of signals.
    """
    vol = F.greatest("vol_estimate", F.lit(1e-9))
    mid_vol = F.greatest(F.percentile(vol, F.lit(0.5)).over(day_window()), F.lit(1e-9))
    x = candidates.withColumn("_x", F.col("positive_signal")
                              - F.lit(vol_blend) * F.log(vol / mid_vol))
    per_day = x.groupBy("as_of").agg(F.collect_list("_x").alias("_xs"), F.max("_x").alias("_top"))
    total = lambda a, v: a + v

    def effective(beta: Column) -> Column:
        e = F.transform("_xs", lambda v: F.exp(beta * (v - F.col("_top"))))
        return _let(e, lambda es: F.pow(F.aggregate(es, F.lit(0.0), total), 2)
                    / F.aggregate(es, F.lit(0.0), lambda a, v: a + v * v))

    wanted = F.greatest(F.lit(2.0), F.least(F.lit(float(rules.target_positions)),
                                            F.size("_xs").cast("double")))
    per_day = per_day.withColumn("_want", wanted)

    def bisect(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2.0
        moved = _let(effective(mid), lambda n: F.struct(
            F.when(n > F.col("_want"), mid).otherwise(s["lo"]).alias("lo"),
            F.when(n > F.col("_want"), s["hi"]).otherwise(mid).alias("hi"),
            F.when(F.abs(n - F.col("_want")) < tolerance, mid).alias("hit")))
        return F.when(s["hit"].isNotNull(), s).otherwise(moved)

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(top).alias("hi"),
                     F.lit(None).cast("double").alias("hit"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, bisect,
                        lambda s: F.coalesce(s["hit"], (s["lo"] + s["hi"]) / 2.0))
    beta = (F.when(effective(F.lit(top)) >= F.col("_want"), F.lit(top))
            .when(F.size("_xs") <= F.col("_want"), F.lit(0.0)).otherwise(found))
    sloped = x.join(per_day.select("as_of", "_top", beta.alias("beta")), "as_of")
    return finish(sloped, F.exp(F.col("beta") * (F.col("_x") - F.col("_top"))), rules)


def blended_weights(active: DataFrame, rules: PortfolioRules, *, alpha: float = 0.5,
                    use_probability: bool = True, min_names: int = 50,
                    require_positive: bool = False) -> DataFrame:
    """Inverse volatility over *all* active names, tilted by the prediction.

    Days with fewer than ``min_names`` names fall back to the signal-weighted
    allocator. A day may hold any number of names, so nothing is windowed over
    it: the day's total, count and its few largest weights decide the cap
    level, and come back by a join on the calendar-sized day table.
    """
    from eventide.operators.candidates import select_candidates
    signal = F.coalesce("predicted_signal", F.lit(0.0))
    tilt = (F.lit(1.0) + (F.coalesce("probability_positive", F.lit(0.5)) - 0.5) * alpha
            if use_probability else F.lit(1.0) + F.tanh(signal * 2.0) * alpha)
    if require_positive:
        tilt = F.when(signal > 0, tilt).otherwise(0.0)
    raw = active.withColumn("weight", F.greatest(tilt, F.lit(0.0)) / F.col("vol_estimate"))
    levels = _top_levels(raw.withColumn("_id", F.col(ENTITY)), "weight",
                         F.sum("weight") * rules.max_weight, _cap_count(rules.max_weight))
    sized = raw.join(F.broadcast(levels), "as_of")
    helpers = ["_n", "_npos", "_total", "_level"]
    small = sized.where(F.col("_n") < min_names).drop("weight", *helpers)
    fallback = inverse_vol_weights(select_candidates(small, rules), rules).select(*OUT)
    flat = F.col("_total") <= 0
    share = F.when(flat, F.lit(1.0) / F.col("_n")).otherwise(F.col("weight") / F.col("_total"))
    level = F.when(flat, F.lit(1.0)).otherwise(F.col("_level"))
    cap = F.lit(rules.max_weight)
    held = F.when(level.isNull(), F.when(share > 0, cap).otherwise(0.0)).otherwise(
        F.least(cap, share * level))
    # What the cap leaves invested is known per day; no further pass over the names.
    invested = (F.when(flat, F.least(F.lit(1.0), F.col("_n") * cap))
                .when(F.col("_level").isNull(), F.col("_npos") * cap).otherwise(F.lit(1.0)))
    out = (sized.where(F.col("_n") >= min_names).withColumn("weight", held)
           .withColumn("_sum", invested).drop(*helpers))
    if rules.max_sector_weight is not None and rules.max_sector_weight < 1.0:
        out = _cap_unbounded(_cap_sectors_unbounded(out.drop("_sum"), rules.max_sector_weight),
                             "as_of", rules.max_weight)
        left = out.groupBy("as_of").agg(F.sum("weight").alias("_sum"))
        out = out.join(F.broadcast(left), "as_of")
    lev = rules.leverage
    scale = F.when(F.col("_sum") > lev, F.lit(lev) / F.col("_sum")).otherwise(1.0)
    out = (out.withColumn("weight", F.col("weight") * scale)
           .withColumn("cash_weight", F.greatest(F.lit(0.0), F.lit(lev) - F.col("_sum"))))
    if not rules.allow_cash:
        # what is left in cash goes to the names in proportion, as far as the cap lets it
        short = (F.col("cash_weight") > 1e-9) & (F.col("_sum") > 0)
        full = out.withColumn("weight", F.when(short, F.col("weight") / F.col("_sum") * lev).otherwise(F.col("weight")))
        full = _cap_unbounded(full.drop("_sum", "cash_weight"), "as_of", rules.max_weight)
        left = full.groupBy("as_of").agg(F.greatest(F.lit(0.0), F.lit(lev) - F.sum("weight")).alias("cash_weight"))
        out = full.join(F.broadcast(left), "as_of")
    return out.where(F.col("weight") > 0).select(*OUT).unionByName(fallback)


def _cap_count(cap: float) -> int:
    """More names than can ever be at the cap."""
    return int(1.0 / cap) + 2


def _top_levels(df: DataFrame, w: str, cap: Column, how_many: int) -> DataFrame:
    """Per day: total, count and fill factor from the ``how_many`` largest weights.

    ``cap`` is an aggregate over the day giving the cap in the units of ``w``.
    At most total / cap weights can reach the cap, so the largest ones decide
    the level exactly, however many rows the day has.
    """
    totals = df.groupBy("as_of").agg(
        F.sum(w).alias("_total"), cap.alias("_cap"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col(w) > 0).alias("_npos"), F.max(w).alias("_max"))
    # Days whose largest weight is within the cap need no list at all.
    over = totals.where(F.col("_max") > F.col("_cap") + 1e-12).select("as_of")
    order = day_window().orderBy(F.col(w).desc(), "_id")
    top = (df.join(F.broadcast(over), "as_of", "left_semi")
           .withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= how_many)
           .groupBy("as_of").agg(F.reverse(F.array_sort(F.collect_list(F.col(w)))).alias("_tops")))
    per = totals.join(top, "as_of", "left")

    def step(s: Column, v: Column) -> Column:
        rest = F.col("_total") - s["ahead"]
        f = F.when(rest > 1e-15, (F.col("_total") - s["k"] * F.col("_cap")) / rest)
        ok = s["f"].isNull() & (v * f <= F.col("_cap") + 1e-12)
        return F.struct((s["k"] + 1).alias("k"), (s["ahead"] + v).alias("ahead"),
                        F.coalesce(s["f"], F.when(ok, f)).alias("f"))

    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("ahead"),
                     F.lit(None).cast("double").alias("f"))
    level = F.when(F.col("_tops").isNull(), F.lit(1.0)).otherwise(
        F.aggregate("_tops", start, step, lambda s: s["f"]))
    return per.select("as_of", "_total", "_n", "_npos", level.alias("_level"))


def _cap_unbounded(df: DataFrame, day: str, cap: float) -> DataFrame:
    ids = df.withColumn("_id", F.col(ENTITY))
    levels = _top_levels(ids, "weight", F.max(F.lit(cap)), _cap_count(cap)).select(day, "_level")
    held = F.when(F.col("_level").isNull(), F.when(F.col("weight") > 0, F.lit(cap)).otherwise(0.0))
    return (df.join(F.broadcast(levels), day)
            .withColumn("weight", held.otherwise(F.least(F.lit(cap),
                                                         F.col("weight") * F.col("_level"))))
            .drop("_level"))


def _cap_sectors_unbounded(df: DataFrame, cap: float) -> DataFrame:
    named = df.withColumn("sector", F.coalesce("sector", F.lit("UNK")))
    sums = (named.groupBy("as_of", "sector").agg(F.sum("weight").alias("_in")))
    leads = sums.withColumn("_id", F.col("sector"))
    levels = _top_levels(leads, "_in", F.sum("_in") * cap, _cap_count(cap)).drop("_n", "_npos")
    limit = F.col("_total") * cap
    share = F.coalesce(F.least(limit, F.col("_in") * F.col("_level")), limit)
    factors = sums.join(levels, "as_of").select(
        "as_of", "sector", F.when(F.col("_in") > 0, share / F.col("_in")).otherwise(0.0).alias("_x"))
    return (named.join(factors, ["as_of", "sector"])
            .withColumn("weight", F.col("weight") * F.col("_x")).drop("_x"))


def limit_turnover(targets: DataFrame, previous: DataFrame, max_turnover: float) -> DataFrame:
    """Scale a day's trades pro rata so that half their absolute sum stays within the limit.

    ``previous`` holds the pre-trade weights (as_of, entity, weight).
    """
    both = (targets.select("as_of", ENTITY, F.col("weight").alias("_new"), F.lit(0.0).alias("_old"))
            .unionByName(previous.select("as_of", ENTITY, F.lit(0.0).alias("_new"),
                                         F.col("weight").alias("_old")))
            .groupBy("as_of", ENTITY).agg(F.sum("_new").alias("_new"), F.sum("_old").alias("_old")))
    traded = both.groupBy("as_of").agg((F.sum(F.abs(F.col("_new") - F.col("_old"))) / 2.0).alias("_traded"))
    ratio = F.least(F.lit(1.0), F.lit(max_turnover) / F.nullif(F.col("_traded"), F.lit(0.0)))
    both = both.join(F.broadcast(traded), "as_of")  # one row per day
    return both.select("as_of", ENTITY, (F.col("_old") + (F.col("_new") - F.col("_old"))
                                         * F.coalesce(ratio, F.lit(1.0))).alias("weight"))
