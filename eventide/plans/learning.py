"""Training, scoring and time-ordered validation with Spark ML.

Every fit runs distributed over a feature-vector table. The driver handles
only model objects, fold boundaries and one metric row per fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce
from itertools import product

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import scalars as S
from eventide.operators import diagnostics as D
from eventide.operators import scale_target as ST
from eventide.plans import boosting as B
from eventide.plans import normal as N
from eventide.session import materialize

LABEL = "target_normalized_signal"


def assemble(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add the ``features`` vector of numeric columns (missing values must be filled already)."""
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df)


def labelled(matrix: DataFrame, label: str = LABEL) -> DataFrame:
    return matrix.where(F.col(label).isNotNull())


def historical_mean(train: DataFrame, label: str = LABEL, weight: str | None = None) -> DataFrame:
    """One row: the (weighted) mean label, the constant prediction to beat."""
    w = F.col(weight) if weight else F.lit(1.0)
    return train.agg((F.sum(w * F.col(label)) / F.sum(w)).alias("prediction"))


def fit_ridge(train: DataFrame, alpha: float = 1.0, weight: str | None = None,
              label: str = LABEL) -> Model:
    """Ridge with penalty ``alpha`` on the sum of squares."""
    return ridge_path(train, [alpha], weight, label)[0]


def ridge_path(train: DataFrame, alphas: list[float], weight: str | None = None,
               label: str = LABEL) -> list[Model]:
    """A ridge model per penalty, from one reading of the rows.

    The normal equations are solved for up to ``normal.WIDEST`` inputs, beyond that Spark's
    iterative solver fits each penalty.
    """
    total = N.sums(train, label, weight)
    if total is None:
        return [_iterated_ridge(train, a, weight, label) for a in alphas]
    return [N.ridge(train.sparkSession, total, a, label) for a in alphas]


def _iterated_ridge(train: DataFrame, alpha: float, weight: str | None, label: str) -> Model:
    """Ridge of any width.

    Spark minimises the mean error on a label scaled to unit deviation, so the
    same solution needs regParam = alpha * std(label) / n. The solver stops when a step
    improves the loss by less than 1e-12 of it.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    y = F.col(label)
    m = train.agg(F.sum(w).alias("n"), F.sum(w * y).alias("s"),
                  F.sum(w * y * y).alias("ss")).first()
    variance = max(m.ss / m.n - (m.s / m.n) ** 2, 0.0)
    est = LinearRegression(featuresCol="features", labelCol=label, elasticNetParam=0.0, standardization=False,
                           regParam=alpha * variance ** 0.5 / m.n, solver="l-bfgs", tol=1e-12, maxIter=2000)
    return (est.setWeightCol(weight) if weight else est).fit(train)


def held_back(train: DataFrame, share: float = 0.2, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """Training rows and, chosen by a hash of the key, the share that early stopping watches."""
    held = F.pmod(F.xxhash64(key), F.lit(1000)) < int(share * 1000)
    return train.where(~held), train.where(held)


def boosted(train: DataFrame, validation: DataFrame, weight: str | None = None, label: str = LABEL,
            rules: B.Boosting = B.Boosting()) -> B.Fitted:
    """Trees on squared error; rounds end when the validation rows' error stops falling."""
    columns = ["features", label] + ([weight] if weight else [])
    if weight and weight not in validation.columns:
        validation = validation.withColumn(weight, F.lit(1.0))
    return B.boost(train.select(*columns), validation.select(*columns), *B.squared(label, weight), rules)


def fit_boosted(train: DataFrame, weight: str | None = None, label: str = LABEL, *,
                validation: DataFrame | None = None, **rules) -> Model:
    """``boosted`` with the given validation rows, or with some of the training rows held back."""
    if validation is None:
        train, validation = held_back(train)
    return boosted(train, validation, weight, label, B.Boosting(**rules)).model


FITTERS: dict[str, Callable[..., Model]] = {"ridge": fit_ridge, "boosted": fit_boosted}


def fit_each(kind: str, train: DataFrame, settings: list[dict], weight: str | None = None) -> list[Model]:
    """A model per setting, all of the same rows; ridge reads them once."""
    if kind == "ridge" and all(set(s) <= {"alpha"} for s in settings):
        return ridge_path(train, [s.get("alpha", 1.0) for s in settings], weight)
    return [FITTERS[kind](train, weight=weight, **s) for s in settings]


def fit_unions(kind: str, parts: list[DataFrame], unions: list[list[int]], label: str = LABEL, weight: str | None = None,
               **params) -> list[Model]:
    """A model of each union of disjoint ``parts``, named by their numbers; ridge reads each part once."""
    def whole(numbers: list[int]) -> DataFrame:
        return reduce(DataFrame.unionByName, [parts[i] for i in numbers])

    if kind != "ridge":
        return [FITTERS[kind](whole(u), weight=weight, label=label, **params) for u in unions]
    totals = []
    for part in parts:
        totals.append(N.sums(part, label, weight))
        if totals[-1] is None:  # as wide as the others
            return [fit_ridge(whole(u), weight=weight, label=label, **params) for u in unions]
    spark, alpha = parts[0].sparkSession, params.get("alpha", 1.0)
    return [N.ridge(spark, reduce(N.added, [totals[i] for i in u]), alpha, label) for u in unions]


def score(model: Model, matrix: DataFrame, model_id: str, model_type: str) -> DataFrame:
    """Prediction table of a fitted model, clipped to [-1, 1]."""
    context = [c for c in ("internal_company_id", "entry_date", "exit_date", "ex_ante_scale",
                           LABEL, "raw_log_return") if c in matrix.columns]
    return (model.transform(matrix)
            .select("sample_id", "split", S.clip("prediction", -1.0, 1.0).alias("predicted_signal"),
                    F.lit(model_id).alias("model_id"), F.lit(model_type).alias("model_type"),
                    *context))


def train_and_predict(matrix: DataFrame, kind: str = "ridge", weighted: bool = True,
                      train_splits: tuple[str, ...] = ("train",), model_id: str | None = None,
                      **params) -> tuple[Model, DataFrame]:
    """Fit on the given splits, score every sample. Pass ("train", "validation") for a final fit."""
    train = labelled(matrix).where(F.col("split").isin(*train_splits))
    weight = None
    if weighted:
        train, weight = ST.frequency_weights(train), "sample_weight"
    if kind == "boosted" and "validation" not in train_splits:
        params = {"validation": labelled(matrix).where(F.col("split") == "validation"), **params}
    model = FITTERS[kind](train, weight=weight, **params)
    return model, score(model, matrix, model_id or f"{kind}_v1", kind)


def attach_context(predictions: DataFrame, samples: DataFrame) -> DataFrame:
    """Left join of the sample columns that later steps need."""
    cols = ["internal_company_id", "entry_date", "exit_date", "ex_ante_scale", LABEL,
            "raw_log_return"]
    bare = predictions.drop(*[c for c in cols if c in predictions.columns])
    return bare.join(samples.select("sample_id", *cols), "sample_id", "left")


@dataclass(frozen=True)
class Fold:
    train_end: date
    eval_end: date


def time_series_folds(samples: DataFrame, n_folds: int = 5, min_train_months: int = 24,
                      min_train: int = 100, min_eval: int = 20) -> list[Fold]:
    """Rolling-origin folds: train up to a date, evaluate up to the next.

    Two small aggregates: the date span, then the sizes of all folds at once.
    """
    span = samples.agg(F.min("entry_date").alias("lo"), F.max("entry_date").alias("hi")).first()
    if span.lo is None:
        return []
    start = span.lo + timedelta(days=min_train_months * 30)
    if start >= span.hi:
        return []
    step = (span.hi - start) / n_folds
    ends = [start + timedelta(days=(step * i).days) for i in range(n_folds)] + [span.hi]
    d = F.col("entry_date")
    sizes = samples.agg(*[F.count_if(d <= F.lit(ends[i])).alias(f"t{i}") for i in range(n_folds)],
                        *[F.count_if((d > F.lit(ends[i])) & (d <= F.lit(ends[i + 1])))
                          .alias(f"e{i}") for i in range(n_folds)]).first()
    return [Fold(ends[i], ends[i + 1]) for i in range(n_folds)
            if sizes[f"t{i}"] >= min_train and sizes[f"e{i}"] >= min_eval]


def grid_search(matrix: DataFrame, kind: str, grid: dict[str, list], metric: str = "spearman",
                n_folds: int = 5, maximise: bool = True, weighted: bool = True) -> tuple[dict, list[dict]]:
    """Mean fold metric of every parameter combination, and the best combination.

    With ``weighted`` each fold's training rows carry their frequency weights, as in the final fit.
    """
    rows = labelled(matrix).where(F.col("split").isin("train", "validation")).persist()
    settings = [dict(zip(grid, values)) for values in product(*grid.values())]
    predicted = None
    try:
        folds = time_series_folds(rows, n_folds)
        for i, f in enumerate(folds):
            part, weight = rows.where(F.col("entry_date") <= F.lit(f.train_end)), None
            if weighted:
                part, weight = ST.frequency_weights(part), "sample_weight"
            held = rows.where((F.col("entry_date") > F.lit(f.train_end))
                              & (F.col("entry_date") <= F.lit(f.eval_end)))
            for j, model in enumerate(fit_each(kind, part, settings, weight)):
                pred = score(model, held, f"{j}_{i}", kind).select("model_id", LABEL, "predicted_signal")
                predicted = pred if predicted is None else predicted.unionByName(pred)
        found = {}
        if predicted is not None:
            # Written, as the metrics read their rows several times.
            metrics = D.regression_metrics(materialize(predicted, "fold-predictions"), ["model_id"], LABEL, "predicted_signal")
            found = {r["model_id"]: r[metric] for r in metrics.collect()}
    finally:
        rows.unpersist()
    results = []
    for j, params in enumerate(settings):
        scores = [found[f"{j}_{i}"] for i in range(len(folds))]
        results.append({**params, metric: sum(scores) / len(scores) if scores else None})
    known = [r for r in results if r[metric] is not None]
    best = (max if maximise else min)(known, key=lambda r: r[metric]) if known else {}
    return best, results


def window_bounds(start: date, end: date, months: int = 3) -> list[tuple[date, date]]:
    """[from, to) windows on calendar quarter (or month) starts, the first at ``start``."""
    def following(d: date) -> date:
        m = (d.month - 1) // months * months + months
        return date(d.year + m // 12, m % 12 + 1, 1)
    edges = [start]
    while following(edges[-1]) <= end:
        edges.append(following(edges[-1]))
    return list(zip(edges, edges[1:] + [end + timedelta(days=1)]))


def walk_forward(matrix: DataFrame, kind: str, start: date, end: date, *, months: int = 3,
                 min_train_months: int = 24, **params) -> DataFrame | None:
    """Expanding-window training; each window is scored by a model that saw only earlier entries."""
    rows = labelled(matrix)
    first = rows.agg(F.min("entry_date")).first()[0]
    windows = [(i, lo, hi) for i, (lo, hi) in enumerate(window_bounds(start, end, months))
               if first is not None and (lo - first).days >= min_train_months * 30]
    if not windows:
        return None
    entry = F.col("entry_date")
    starts = [lo for _, lo, _ in windows]
    # What a window trains on beyond the window before it.
    parts = [rows.where(entry < F.lit(starts[0]))] + [
        rows.where((entry >= F.lit(a)) & (entry < F.lit(b))) for a, b in zip(starts, starts[1:])]
    models = fit_unions(kind, parts, [list(range(n + 1)) for n in range(len(parts))], **params)
    stitched = None
    for (i, lo, hi), model in zip(windows, models):
        held = rows.where((entry >= F.lit(lo)) & (entry < F.lit(hi)))
        part = (score(model, held, f"{kind}_walk_{i:03d}_{lo}", kind)
                .withColumn("window", F.lit(i)).withColumn("window_start", F.lit(str(lo)))
                .withColumn("window_end", F.lit(str(hi))))
        stitched = part if stitched is None else stitched.unionByName(part)
    return stitched


def fit_ranker(matrix: DataFrame, rules: B.Boosting = B.Boosting(), at: int = 10) -> tuple[B.Fitted, DataFrame]:
    """Cross-sectional ranking model: trees on a pairwise loss among the rows of a quarter.

    Relevance is graded by return within the quarter. Rounds end when NDCG of the validation
    quarters stops rising. Scores become signals by their rank within the quarter.
    """
    graded = ST.rank_labels(matrix.where(F.col("raw_log_return").isNotNull()))
    columns = ["sample_id", "quarter", "relevance", "features"]
    part = lambda name: graded.where(F.col("split") == name).select(*columns)
    fitted = B.boost(part("train"), part("validation"), *B.ranking("quarter", "relevance", "sample_id", at=at), rules)
    scored = fitted.model.transform(graded).withColumnRenamed("prediction", "raw_score")
    return fitted, D.quarter_rank_signal(scored.drop("features"), "raw_score")


def reward_weighted_rounds(matrix: DataFrame, kind: str = "ridge", reward_scale: float = 8.0,
                           **params) -> DataFrame:
    """Score each time quartile out of sample, weight by reward, then fit once more on the weights."""
    train = materialize(ST.time_quartiles(labelled(matrix).where(F.col("split") == "train")), "quartiles")
    quartiles = [train.where(F.col("time_quartile") == q) for q in range(1, 5)]
    models = fit_unions(kind, quartiles, [[i for i in range(4) if i != out] for out in range(4)], **params)
    parts = None
    for q, model in enumerate(models, 1):
        part = score(model, train.where(F.col("time_quartile") == q), f"{kind}_q{q}", kind)
        parts = part if parts is None else parts.unionByName(part)
    weights = ST.reward_weights(parts, "predicted_signal", "raw_log_return", reward_scale).select(
        "sample_id", "reward_weight")
    final = FITTERS[kind](train.join(weights, "sample_id"), weight="reward_weight", **params)
    return score(final, matrix, f"{kind}_self", kind)


def save_model(model: Model, path: str) -> None:
    model.write().overwrite().save(path)


def feature_arrays(matrix: DataFrame) -> DataFrame:
    """The feature vector as an array column, for export."""
    return matrix.withColumn("features", vector_to_array("features"))
