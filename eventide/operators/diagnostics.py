"""Does the score sort future returns? Bucket tables, rank correlation, metrics, ensembles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators.benchmarks import hash_order
from eventide.operators.ordered import (average_rank, exact_quantiles, ordered_counts,
                                        quantile_buckets, spearman)


def _scored(df: DataFrame, signal: str, ret: str) -> DataFrame:
    return df.where(F.col(signal).isNotNull() & F.col(ret).isNotNull())


def decile_table(df: DataFrame, q: int = 10, signal: str = "predicted_signal",
                 ret: str = "raw_log_return", target: str = "target_normalized_signal",
                 benchmark: str = "spy_log_return") -> DataFrame:
    """Realised outcomes per equal-frequency bucket of the score."""
    marked = quantile_buckets(_scored(df, signal, ret), signal, q)
    means = marked.groupBy("bucket").agg(
        F.avg(signal).alias(f"{signal}_mean"), F.avg(ret).alias(f"{ret}_mean"),
        F.count(F.lit(1)).alias("count"), F.avg(target).alias(f"{target}_mean"),
        F.avg(F.col(ret) - F.col(benchmark)).alias("excess_vs_spy_mean"))
    medians = exact_quantiles(marked, ["bucket"], ret, [0.5]).select(
        "bucket", F.col("q")[0].alias(f"{ret}_median"))
    return means.join(medians, "bucket")


def top_minus_bottom(df: DataFrame, q: int = 10, signal: str = "predicted_signal",
                     ret: str = "raw_log_return") -> DataFrame:
    marked = quantile_buckets(_scored(df, signal, ret), signal, q)
    means = marked.groupBy("bucket").agg(F.avg(ret).alias("m"))
    return means.agg((F.max_by("m", "bucket") - F.min_by("m", "bucket")).alias("spread"))


def with_quarter(df: DataFrame) -> DataFrame:
    return df.withColumn("quarter", S.quarter_label("entry_date"))


def quarterly_rank_correlation(df: DataFrame, signal: str = "predicted_signal",
                               ret: str = "raw_log_return") -> DataFrame:
    """Spearman correlation per entry quarter; null below five rows."""
    return spearman(with_quarter(df.where(F.col("entry_date").isNotNull())), ["quarter"],
                    signal, ret, min_rows=5)


def _same_sign(a: str, b: str) -> Column:
    return (F.signum(a) == F.signum(b)).cast("int")


def quarterly_direction_accuracy(df: DataFrame, signal: str = "predicted_signal",
                                 ret: str = "raw_log_return") -> DataFrame:
    return (with_quarter(_scored(df, signal, ret)).groupBy("quarter")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.avg(_same_sign(signal, ret)).alias("direction_accuracy")))


def diagnostics_rollup(df: DataFrame, holdings_concentration: DataFrame | None = None) -> DataFrame:
    """Mean quarterly rank correlation, positive quarters, mean accuracy and concentration."""
    rho = quarterly_rank_correlation(df).agg(
        F.avg("spearman").alias("mean_spearman"),
        F.count_if(F.col("spearman") > 0).alias("positive_quarters"),
        F.count("spearman").alias("quarters"))
    hit = quarterly_direction_accuracy(df).agg(F.avg("direction_accuracy")).scalar()
    out = rho.withColumn("mean_direction_accuracy", hit)
    if holdings_concentration is not None:
        for source, name in (("herfindahl", "mean_herfindahl"), ("top10_weight", "mean_top10_weight")):
            out = out.withColumn(name, holdings_concentration.agg(F.avg(source)).scalar())
    return out


def top_vs_random(df: DataFrame, n: int = 50, trials: int = 25, seed: int = 42,
                  signal: str = "predicted_signal", ret: str = "raw_log_return",
                  key: str = "sample_id") -> DataFrame:
    """Mean return of each date's top positives against repeated random positives.

    Draws follow a hash order per trial, so they do not depend on partitioning,
    and each task keeps only its n first rows per trial and date.
    """
    positive = _scored(df, signal, ret).where((F.col(signal) > 0) & F.col("entry_date").isNotNull())
    best = Window.partitionBy("entry_date").orderBy(F.col(signal).desc(), key)
    model = (positive.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= n)
             .groupBy("entry_date").agg(F.avg(ret).alias("m")).agg(F.avg("m")).scalar())
    trial = F.explode(F.sequence(F.lit(1), F.lit(trials)))
    drawn = Window.partitionBy("trial", "entry_date").orderBy(hash_order(seed, "trial", key), key)
    random = (positive.select("entry_date", key, ret, trial.alias("trial"))
              .withColumn("_k", F.row_number().over(drawn)).where(F.col("_k") <= n)
              .groupBy("trial", "entry_date").agg(F.avg(ret).alias("m"))
              .groupBy("trial").agg(F.avg("m").alias("m")))
    spread = F.col("model_mean") - F.col("random_mean")
    error = F.greatest(F.col("_sd") / F.sqrt(F.col("n_trials")), F.lit(1e-12))
    return (random.agg(F.avg("m").alias("random_mean"), F.stddev_samp("m").alias("_sd"),
                       F.count("m").alias("n_trials"))
            .withColumn("model_mean", model)
            .select("model_mean", "random_mean", spread.alias("spread"),
                    F.when(F.col("_sd") > 0, spread / error).alias("model_t_stat"), "n_trials"))


def regression_metrics(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """MSE, MAE, direction accuracy, Pearson, Spearman and R2 per group."""
    pairs = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    err = F.col(pred) - F.col(truth)
    spread = (F.stddev_pop(pred) > 0) & (F.stddev_pop(truth) > 0)
    total = F.var_pop(truth) * F.count(F.lit(1))
    basic = pairs.groupBy(*by).agg(
        F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.avg(_same_sign(pred, truth)).alias("direction_accuracy"),
        F.when(spread, S.correlation(pred, truth)).otherwise(0.0).alias("pearson"),
        (F.lit(1.0) - F.sum(err * err) / F.when(total > 0, total).otherwise(1e-12)).alias("r2"),
        F.count(F.lit(1)).alias("n"))
    rho = spearman(pairs, by, pred, truth).drop("n")
    return basic.join(rho, by).withColumn("spearman", F.coalesce("spearman", F.lit(0.0)))


def bucket_report(df: DataFrame, truth: str, pred: str, buckets: int = 10) -> DataFrame:
    """Mean prediction and truth per fixed-width bucket of [-1, 1]."""
    width = 2.0 / buckets
    index = F.least(F.width_bucket(F.col(pred), F.lit(-1.0), F.lit(1.0), F.lit(buckets)),
                    F.lit(buckets)) - 1
    inside = df.where(F.col(pred).between(-1.0, 1.0))
    return (inside.groupBy(index.alias("_b"))
            .agg(F.count(F.lit(1)).alias("count"), F.avg(pred).alias("mean_predicted"),
                 F.avg(truth).alias("mean_true"))
            .select((F.col("_b") * width - 1.0).alias("bucket_lo"),
                    ((F.col("_b") + 1) * width - 1.0).alias("bucket_hi"), "count",
                    "mean_predicted", "mean_true"))


def mean_ensemble(models: list[DataFrame], model_id: str = "ensemble_v1") -> DataFrame:
    """Average signal of the samples every model scored, clipped to [-1, 1].

    One grouped pass with a count instead of a chain of joins.
    """
    return _combined(_stacked(models), F.col("predicted_signal"), lambda m: m, len(models),
                     model_id, "ensemble")


def rank_ensemble(models: list[DataFrame], model_id: str = "ensemble_rank_v1") -> DataFrame:
    """Average percent rank within split, back on [-1, 1]."""
    ranked = average_rank(_stacked(models), ["_model", "split"], "predicted_signal", "_rank")
    return _combined(ranked, F.col("_rank"), lambda m: m * 2.0 - 1.0, len(models), model_id,
                     "ensemble_rank")


def _stacked(models: list[DataFrame]) -> DataFrame:
    parts = [m.select("sample_id", "split", "predicted_signal", F.lit(i).alias("_model"))
             for i, m in enumerate(models)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _combined(stacked: DataFrame, value: Column, rescale, n: int, model_id: str,
              model_type: str) -> DataFrame:
    return (stacked.groupBy("sample_id", "split")
            .agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"))
            .where(F.col("_n") == n)
            .select("sample_id", "split", S.clip(rescale(F.col("_m")), -1.0, 1.0)
                    .alias("predicted_signal"),
                    F.lit(model_id).alias("model_id"), F.lit(model_type).alias("model_type")))


def quarter_rank_signal(df: DataFrame, score: str) -> DataFrame:
    """Raw scores to signals: 2 x average percent rank within the entry quarter - 1."""
    ranked = average_rank(with_quarter(df), ["quarter"], score, "_pct")
    return ranked.withColumn("predicted_signal", F.col("_pct") * 2.0 - 1.0).drop("_pct")


def latest_cohort(scores: DataFrame) -> DataFrame:
    """Scores whose entry lies in the newest quarter present."""
    newest = scores.agg(F.max(F.date_trunc("quarter", F.col("entry_date")))).scalar()
    return scores.where(F.date_trunc("quarter", F.col("entry_date")) == newest)


def rank_in_cohort(scores: DataFrame, cohort: DataFrame, score: str = "raw_score",
                   shrink: float = 0.25, limit: float = 0.4) -> DataFrame:
    """Place scores among a reference cohort: rank / (n + 1), signal, and a shrunk signal.

    Equal scores share the lowest rank. The counts come from the distributed
    order statistics over the union, so the cohort may be of any size.
    """
    union = scores.select(score).unionByName(cohort.select(score))
    place = ordered_counts(union, [], score).select(
        score, ((F.col("below") + 1) / (F.col("total") + 1)).alias("rank_pct"))
    out = scores.join(place, score, "left")
    signal = F.col("rank_pct") * 2.0 - 1.0
    return (out.withColumn("predicted_signal", signal)
            .withColumn("shrunk_signal", S.clip(signal * shrink, -limit, limit)))


def describe_scores(ranked: DataFrame, k: float = 2.5) -> DataFrame:
    """Direction, confidence, expected return and annual volatility of ranked scores."""
    return (ranked.withColumn("direction", S.direction_label("predicted_signal"))
            .withColumn("confidence", S.confidence_label("rank_pct"))
            .withColumn("expected_log_return",
                        S.restore_signal("shrunk_signal", "ex_ante_scale", k=k))
            .withColumn("expected_pct_return", F.exp("expected_log_return") - 1.0)
            .withColumn("annualized_vol", S.annualised_vol("ex_ante_scale", "holding_days")))


def suggested_longs(scores: DataFrame, n: int) -> DataFrame:
    """The n strongest positive signals with inverse-scale weights."""
    top = (scores.where(F.col("predicted_signal") > 0)
           .orderBy(F.col("predicted_signal").desc(), "sample_id").limit(n))
    inverse = F.lit(1.0) / F.greatest("ex_ante_scale", F.lit(1e-3))
    return top.withColumn("suggested_weight",
                          inverse / F.sum(inverse).over(Window.partitionBy(F.lit(0))))


def ndcg(df: DataFrame, by: str, score: str, relevance: str, k: int,
         key: str = "sample_id") -> DataFrame:
    """NDCG at k per group with gains 2^relevance - 1; only k rows per order are ranked."""
    gain = (F.pow(F.lit(2.0), F.col(relevance)) - 1.0) / F.log2(F.col("_k") + 1.0)

    def top(order: Column, out: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(order, key)
        return (df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k)
                .groupBy(by).agg(F.sum(gain).alias(out)))

    got, best = top(F.col(score).desc(), "dcg"), top(F.col(relevance).desc(), "ideal")
    return got.join(best, by).select(by, F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal"))
                                     .otherwise(0.0).alias("ndcg"))
