"""Ridge by normal equations: exact, rows read once for many fits, Spark's own model."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import functions as F

from eventide.plans import learning as L
from eventide.plans import normal as N

WIDTH = 7


def rows(spark, n=400, seed=1):
    """Rows of known inputs, one of them constant and one never set; every third vector dense."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, WIDTH)) < 0.5, rng.normal(size=(n, WIDTH)) * 10.0 ** np.arange(-3, WIDTH - 3), 0.0)
    x[:, 2], x[:, 5] = 3.0, 0.0
    y = x[:, 0] * 300 + 0.5 * x[:, 3] + rng.normal(size=n)
    w = rng.uniform(0.2, 3.0, n)
    days = rng.integers(0, 1500, n)
    data = []
    for i in range(n):
        known = np.flatnonzero((x[i] != 0) | (np.arange(WIDTH) == 5))
        v = Vectors.dense(x[i]) if i % 3 == 0 else Vectors.sparse(WIDTH, known, x[i][known])
        data.append((f"s{i:04d}", f"c{i % 9}", date(2000, 1, 3) + timedelta(days=int(days[i])), "train" if days[i] < 1200 else "test",
                     float(y[i]), float(y[i] / 50), float(w[i]), v))
    names = ["sample_id", "internal_company_id", "entry_date", "split", L.LABEL, "raw_log_return", "w", "features"]
    return spark.createDataFrame(data, names), x, y, w, days


def exact(x, y, w, alpha):
    mx, my = (w @ x) / w.sum(), (w @ y) / w.sum()
    c = np.linalg.solve((x - mx).T @ ((x - mx) * w[:, None]) + alpha * np.eye(x.shape[1]), (x - mx).T @ (w * (y - my)))
    return c, my - mx @ c


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_fit_is_exact(spark, alpha):
    df, x, y, w, _ = rows(spark)
    c, b = exact(x, y, w, alpha)
    model = L.fit_ridge(df, alpha, "w")
    assert np.allclose(model.coefficients.toArray(), c, rtol=1e-10, atol=1e-12) and model.intercept == pytest.approx(b, rel=1e-10)
    got = {r.sample_id: r.prediction for r in model.transform(df).select("sample_id", "prediction").collect()}
    assert np.allclose([got[f"s{i:04d}"] for i in range(len(y))], x @ c + b, rtol=1e-9)


def test_model_is_saved_and_loaded(spark, tmp_path):
    df = rows(spark)[0]
    model = L.fit_ridge(df)
    L.save_model(model, str(tmp_path / "m"))
    again = LinearRegressionModel.load(str(tmp_path / "m"))
    assert again.coefficients == model.coefficients and again.getFeaturesCol() == "features"


def test_wider_than_the_matrix_falls_back(spark, monkeypatch):
    df, x, y, w, _ = rows(spark)
    monkeypatch.setattr(N, "WIDEST", WIDTH - 1)
    assert N.sums(df, L.LABEL) is None
    c, _ = exact(x, y, w, 1.0)
    assert np.allclose(L.fit_ridge(df, 1.0, "w").transform(df).agg(F.sum("prediction")).first()[0], (x @ c).sum() + len(y) * exact(x, y, w, 1.0)[1], rtol=1e-3)


def test_windows_read_each_row_once(spark, monkeypatch):
    df, x, y, _, days = rows(spark)
    seen, plain = [], N.sums
    monkeypatch.setattr(N, "sums", lambda r, *a, **k: (seen.append(r.count()), plain(r, *a, **k))[1])
    out = L.walk_forward(df, "ridge", date(2002, 1, 1), date(2003, 12, 31), months=6, min_train_months=6)
    got = {r.sample_id: (r.predicted_signal, r.window_start) for r in out.collect()}
    assert sum(seen) <= len(y) and len({v[1] for v in got.values()}) == 4
    for i in range(len(y)):
        if f"s{i:04d}" in got:
            signal, start = got[f"s{i:04d}"]
            before = days < (date.fromisoformat(start) - date(2000, 1, 3)).days
            c, b = exact(x[before], y[before], np.ones(before.sum()), 1.0)
            assert signal == pytest.approx(np.clip(x[i] @ c + b, -1, 1), abs=1e-8)


def test_quartiles_and_grid_share_their_sums(spark, monkeypatch):
    df = rows(spark)[0]
    seen, plain = [], N.sums
    monkeypatch.setattr(N, "sums", lambda r, *a, **k: (seen.append(r.count()), plain(r, *a, **k))[1])
    assert L.reward_weighted_rounds(df, "ridge", alpha=1.0).count() == df.count()
    train = df.where("split = 'train'").count()
    assert seen[:4] and sum(seen[:4]) == train and seen[4:] == [train]
    seen.clear()
    best, results = L.grid_search(df, "ridge", {"alpha": [1.0, 100.0, 1e6]}, n_folds=3)
    assert len(results) == 3 and best in results and len(seen) <= 3


def test_rows_without_weight_or_with_gaps_raise(spark):
    df = rows(spark)[0]
    with pytest.raises(ValueError, match="rows with weight"):
        L.fit_ridge(df.where("false"))
    with pytest.raises(ValueError, match="finite"):
        L.fit_ridge(df.withColumn(L.LABEL, F.when(F.col("sample_id") != "s0001", F.col(L.LABEL))))
