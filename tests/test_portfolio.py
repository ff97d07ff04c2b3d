"""Weights, accounting, overlays and covariance against brute force."""

import datetime as dt
import hashlib
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from eventide.operators import accounting as A
from eventide.operators import benchmarks as B
from eventide.operators import interval_top as IT
from eventide.operators import calendar as cal
from eventide.operators import candidates as C
from eventide.operators import denoise as N
from eventide.operators import market_features as mf
from eventide.operators import overlays as O
from eventide.operators import performance as P
from eventide.operators import weights as W

D = dt.date
RULES = C.PortfolioRules(min_weight=0.0)


def check_capped(raw, got, cap):
    """The conditions that single out the capped weights: nothing above the cap, the
    total kept if the cap allows it, and the names below it still in their old proportion."""
    raw, got = np.asarray(raw, float), np.asarray(got, float)
    assert (got <= cap + 1e-9).all() and (got >= 0).all()
    live = raw > 0
    assert np.isclose(got.sum(), min(raw.sum(), cap * live.sum()))
    below = live & (got < cap - 1e-9)
    ratio = got[below] / raw[below]
    assert np.allclose(ratio, ratio[:1])
    at = live & ~below
    if below.any():  # a capped name would exceed the cap at the others' ratio
        assert (raw[at] * ratio[0] >= cap - 1e-9).all()


def _candidates(spark, days=30, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(days):
        for j in range(int(rng.integers(1, 40))):
            rows.append((D(2024, 1, 1) + dt.timedelta(days=i), i, f"N{j:03d}", f"S{j % 4}",
                         float(rng.pareto(1.2) + 0.05), float(rng.uniform(0.005, 0.1))))
    df = spark.createDataFrame(rows, "as_of date, seq int, internal_company_id string, sector string, "
                               "predicted_signal double, vol_estimate double")
    return C.select_candidates(df, RULES), pd.DataFrame(
        rows, columns=["as_of", "seq", "id", "sector", "s", "vol"])


def test_caps_meet_their_conditions(spark):
    picked, pdf = _candidates(spark)
    for cap in (0.05, 0.2, 0.4):
        got = W.inverse_vol_weights(picked, replace(RULES, max_weight=cap)).toPandas()
        for day, rows in pdf.groupby("as_of"):
            raw = (rows.s / rows.vol) / (rows.s / rows.vol).sum()
            mine = got[got.as_of == day].set_index("internal_company_id").weight
            check_capped(raw, [mine.get(i, 0.0) for i in rows.id], cap)
        assert np.allclose(got.groupby("as_of").weight.sum() + got.groupby("as_of").cash_weight.max(), 1)


def test_two_names_at_the_cap_leave_cash(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 0, "a", "x", 0.6, 0.1), (D(2024, 1, 1), 0, "b", "x", 0.4, 0.1)],
                               "as_of date, seq int, internal_company_id string, sector string, predicted_signal double, vol_estimate double")
    rows = W.inverse_vol_weights(C.select_candidates(df, RULES), replace(RULES, max_weight=0.4)).collect()
    assert sorted(round(r.weight, 12) for r in rows) == [0.4, 0.4]
    assert abs(rows[0].cash_weight - 0.2) < 1e-12


def test_sector_cap_holds(spark):
    picked, _ = _candidates(spark, seed=5)
    got = W.inverse_vol_weights(picked, replace(RULES, max_weight=0.5, max_sector_weight=0.4)).toPandas()
    shares = got.groupby(["as_of", "sector"]).weight.sum()
    assert shares.max() <= 0.4 + 1e-9
    assert (got.groupby("as_of").sector.nunique() >= 3).any()


def test_blended_equals_windowed_rule(spark):
    """The pass without day windows agrees with the definition, caps biting or not."""
    picked, _ = _candidates(spark, seed=9)
    active = picked.withColumn("probability_positive", F.lit(0.5) + F.least("predicted_signal", F.lit(1.0)) / 2)
    for cap, sector in ((0.03, None), (0.2, None), (0.3, 0.4)):
        rules = replace(RULES, max_weight=cap, max_sector_weight=sector)
        got = W.blended_weights(active, rules, min_names=3).toPandas().set_index(["as_of", "internal_company_id"]).weight
        raw = (F.lit(1.0) + (F.col("probability_positive") - 0.5) * 0.5) / F.col("vol_estimate")
        n = F.count(F.lit(1)).over(W.day_window())
        want = W.finish(active.withColumn("_n", n).where("_n >= 3"), raw, rules, drop_small=False)
        want = want.toPandas().set_index(["as_of", "internal_company_id"]).weight
        got = got[got.index.isin(want.index)]
        assert len(got) == len(want) and np.allclose(got.loc[want.index], want, atol=1e-9)


def test_max_entropy_reaches_the_effective_number(spark):
    rng = np.random.default_rng(2)
    rows = [(D(2024, 1, 1), 0, f"N{j:02d}", "x", float(rng.uniform(0.05, 1)), float(rng.uniform(0.01, 0.05)))
            for j in range(80)]
    df = spark.createDataFrame(rows, "as_of date, seq int, internal_company_id string, sector string, predicted_signal double, vol_estimate double")
    rules = replace(RULES, target_positions=20, max_weight=1.0)
    w = np.array([r.weight for r in W.max_entropy_weights(C.select_candidates(df, rules), rules).collect()])
    assert abs(1 / (w ** 2).sum() - 20) < 0.5 and abs(w.sum() - 1) < 1e-9


def _world(spark):
    c = cal.calendar_between(spark, "2024-01-02", "2024-03-15")
    days = cal.trading_days(c)
    dates = [r.date for r in days.orderBy("seq").collect()]
    rng = np.random.default_rng(4)
    path = {k: 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(dates)))) for k in "abc"}
    grid = spark.createDataFrame([(k, i, d, float(path[k][i]), 10.0) for k in "abc" for i, d in enumerate(dates)],
                                 "internal_company_id string, seq int, date date, adjusted_close double, volume double")
    return c, days, dates, path, grid


def test_accounting_matches_day_loop(spark):
    c, days, dates, path, grid = _world(spark)
    plan = {3: {"a": 0.5, "b": 0.3}, 10: {"b": 0.6, "c": 0.4}, 20: {}, 25: {"a": 0.9}}
    ends = [3, 10, 20, 25]
    preds = spark.createDataFrame([(f"p{i}", "a", dates[i], dates[i]) for i in ends],
                                  "sample_id string, internal_company_id string, entry_date date, exit_date date")
    targets = spark.createDataFrame(
        [(dates[s], s, k, w, 1 - sum(p.values())) for s, p in plan.items() for k, w in p.items()],
        "as_of date, seq int, internal_company_id string, weight double, cash_weight double")
    out = A.account(targets, preds, grid, days, cost_bps=10.0)
    daily = out["daily"].orderBy("seq").toPandas()

    held, cash, value = {}, 1.0, 1.0
    for t, d in enumerate(dates):
        gross = 0.0
        if t and held:
            grown = {k: w * path[k][t] / path[k][t - 1] for k, w in held.items()}
            gross = sum(grown.values()) - sum(held.values())
            total = sum(grown.values()) + cash
            held, cash = {k: v / total for k, v in grown.items()}, cash / total
        cost = turn = 0.0
        if t in plan:
            moves = [abs(plan[t].get(k, 0) - held.get(k, 0)) for k in set(held) | set(plan[t])]
            turn, cost = sum(moves) / 2, sum(moves) * 0.001
            held, cash = dict(plan[t]), 1 - sum(plan[t].values())
        value *= 1 + gross - cost
        row = daily.iloc[t]
        assert np.allclose([row.gross_return, row.transaction_cost_return, row.turnover, row.portfolio_value],
                           [gross, cost, turn, value], atol=1e-12)
        assert row.n_positions == len(held)
    assert {r.reason for r in out["trades"].collect()} == {"new_signal", "rebalance", "exit"}


def test_active_days_and_counts_with_overlaps(spark):
    c, days, dates, _, _ = _world(spark)
    rows = [("a", 0, 9, "p1"), ("a", 5, 12, "p2"), ("b", 2, 20, "p3"), ("b", 4, 6, "p4"), ("b", 21, 25, "p5"),
            ("c", 30, 31, "p6")]
    preds = spark.createDataFrame([(s, e, dates[x], dates[y], 0.1) for e, x, y, s in rows],
                                  "sample_id string, internal_company_id string, entry_date date, exit_date date, predicted_signal double")
    got = {(r.seq, r.internal_company_id): r.sample_id for r in C.active_by_day(preds, c, days).collect()}
    want = {}
    for t in range(len(dates)):
        for e in "abc":
            live = [(x, s) for en, x, y, s in rows if en == e and x <= t <= y]
            if live:
                want[(t, e)] = max(live)[1]
    assert got == want
    counts = {(r.internal_company_id, r.seq): (r.active, r.started, r.ended)
              for r in B.active_counts(preds, c, days).collect()}
    assert counts[("b", 20)] == (1, 0, 0) and counts[("b", 21)] == (1, 0, 0)  # adjoining: no exit
    assert counts[("a", 13)] == (0, 0, 1) and counts[("a", 5)] == (1, 0, 0)
    assert {k for k, v in counts.items() if v[0]} == {(e, t) for t, e in want}


def test_top_by_day_equals_every_day_ranked(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        lo = int(rng.integers(0, 100))
        rows.append((f"N{i:04d}", float(rng.integers(0, 30)) / 10, lo, min(99, lo + int(rng.integers(0, 70)))))
    df = spark.createDataFrame(rows, "internal_company_id string, s double, _a long, _b long")
    got = {(r.seq, r["_k"]): r.internal_company_id for r in IT.top_by_day(df, 99, lambda: [F.desc("s"), F.col("internal_company_id")], 7).collect()}
    want = {}
    for t in range(100):
        held = sorted((-s, e) for e, s, a, b in rows if a <= t <= b)[:7]
        want |= {(t, k): e for k, (_, e) in enumerate(held, 1)}
    assert got == want
    blocks = IT.dyadic_blocks(df, 99).collect()
    covered = sorted((r.internal_company_id, t) for r in blocks for t in range(r["_block"] << r["_size"], (r["_block"] + 1) << r["_size"]))
    assert covered == sorted((e, t) for e, _, a, b in rows for t in range(a, b + 1))


def test_contenders_leave_few_rows_and_every_best(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        lo = int(rng.integers(0, 200))
        s = None if i % 50 == 0 else float("nan") if i % 997 == 1 else float(rng.normal()) if i % 3 else 1.5
        rows.append((f"N{i:04d}", i % 2, s, lo, min(199, lo + int(rng.integers(0, 120)))))
    df = spark.createDataFrame(rows, "internal_company_id string, g int, s double, _a long, _b long")
    rank = lambda s: (s is None, 0.0 if s is None else -float("inf") if s != s else -s)
    for kinds, k in ((None, 5), (["g"], 5), (None, 4000)):
        left = IT.contenders(df, 199, "s", k, kinds).collect()
        days = [(r.internal_company_id, t) for r in left for t in range(r["_a"], r["_b"] + 1)]
        assert len(days) == len(set(days)) and (len(left) < 1200 or k > 5)
        for t in range(200):
            for g in (0, 1) if kinds else (None,):
                best = sorted((rank(s), e) for e, kind, s, a, b in rows if a <= t <= b and g in (None, kind))[:k]
                assert {(e, t) for _, e in best} <= set(days)
    order = lambda: [F.desc("s"), F.col("internal_company_id")]
    plain, cut = (IT.top_by_day(df, 199, order, 5, lead=lead).select("seq", "_k", "internal_company_id") for lead in (None, "s"))
    assert sorted(plain.collect()) == sorted(cut.collect())


def test_within_spans_cuts_intervals(spark):
    vols = spark.createDataFrame([("m", t) for t in (2, 3, 4, 8, 9)], "k string, seq long")
    rows = spark.createDataFrame([("m", "x", 0, 8), ("m", "y", 5, 7), ("n", "z", 0, 9)], "k string, e string, _a long, _b long")
    got = sorted((r.e, r["_a"], r["_b"]) for r in IT.within(rows, IT.spans(vols, "k"), "k").collect())
    assert got == [("x", 2, 4), ("x", 8, 8)]


def test_random_names_are_a_day_of_uniform_draws(spark):
    days = spark.createDataFrame([(t, D(2024, 1, 1) + dt.timedelta(days=t)) for t in range(16)], "seq long, date date")
    df = spark.createDataFrame([(f"N{i:04d}", i % 5, 15 - i % 3) for i in range(300)], "internal_company_id string, _a long, _b long")
    got = B.random_names(df, days, 20).collect()
    again = B.random_names(df.repartition(7), days, 20).collect()
    assert {(r.seq, r["_k"], r.internal_company_id) for r in got} == {(r.seq, r["_k"], r.internal_company_id) for r in again}
    assert all(int(r.internal_company_id[1:]) % 5 <= r.seq <= 15 - int(r.internal_company_id[1:]) % 3 for r in got)
    assert {t: sum(r.seq == t for r in got) for t in range(16)} == dict.fromkeys(range(16), 20)


def test_random_names_draw_anew_every_day(spark):
    days = spark.createDataFrame([(t, D(2024, 1, 1) + dt.timedelta(days=t)) for t in range(16)], "seq long, date date")
    rows = [(f"N{i:04d}", i % 5, 15 - i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "internal_company_id string, _a long, _b long")
    want = set()
    for t in range(16):
        day = D(2024, 1, 1) + dt.timedelta(days=t)
        held = sorted((hashlib.sha1(f"42|{day}|{e}".encode()).hexdigest(), e) for e, a, b in rows if a <= t <= b)[:20]
        want |= {(t, k, e) for k, (_, e) in enumerate(held, 1)}
    for spare in (4.0, 1.0, 0.1):  # with little to spare days fall short and are ordered in full
        got = B.random_names(df, days, 20, spare=spare).collect()
        assert {(r.seq, r["_k"], r.internal_company_id) for r in got} == want and len(got) == len(want)


def test_market_mode_share_matches_correlation(spark):
    rng = np.random.default_rng(8)
    t, n = 60, 15
    common = rng.normal(size=t)
    r = 0.6 * common[:, None] + rng.normal(size=(t, n))
    r[:, 3] = 0.0
    rows = [(f"k{j}", i, D(2024, 1, 1) + dt.timedelta(days=i), float(r[i, j])) for i in range(t) for j in range(n)]
    df = spark.createDataFrame(rows, "k string, seq int, date date, r double")
    got = {x.date: x.mode_share for x in mf.market_mode_share(df, "k", lookback=40, stride=10).collect()}
    for end in (40, 50, 60):
        w = r[end - 40:end]
        keep = w.std(axis=0) > 0
        corr = np.zeros((n, n))
        corr[np.ix_(keep, keep)] = np.corrcoef(w[:, keep], rowvar=False)
        want = np.linalg.eigvalsh(corr)[-1] / np.trace(corr)
        assert abs(got[D(2024, 1, 1) + dt.timedelta(days=end - 1)] - want) < 1e-9
    assert len(got) == 3


def test_covariance_and_denoising(spark):
    rng = np.random.default_rng(3)
    panel = rng.normal(0, 0.01, (100, 6))
    shrunk = N.shrunk_covariance(panel, 0.5)
    cov = np.cov(panel, rowvar=False)
    assert np.allclose(np.diag(shrunk), np.diag(cov)) and np.allclose(shrunk[0, 1], cov[0, 1] / 2)
    clean = N.denoised_covariance(panel)
    assert np.allclose(clean, clean.T) and np.linalg.eigvalsh(clean)[0] > 0
    assert np.allclose(np.sqrt(np.diag(clean)), panel.std(axis=0, ddof=1), rtol=1e-3)
    w = N.tilted_min_variance(np.diag([1e-4, 1e-4, 9e-4]), np.array([0.3, 0.3, 0.3]), 5.0)
    assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and np.isclose(w[0], w[1]) and w[1] > w[2]
    w = N.tilted_min_variance(np.diag([1e-4, 1e-4]), np.array([0.6, 0.4]), 5.0)
    assert w[0] > w[1]


def test_denoised_covariance_keeps_the_market_mode():
    rng = np.random.default_rng(4)
    market = rng.normal(0, 0.02, (250, 1))
    panel = market + rng.normal(0, 0.01, (250, 30))
    clean, corr = N.denoised_covariance(panel), np.corrcoef(panel, rowvar=False)
    unit = clean / np.outer(*[np.sqrt(np.diag(clean))] * 2)
    assert np.allclose(np.diag(clean), panel.var(axis=0, ddof=1))
    assert np.isclose(np.linalg.eigvalsh(unit)[-1], np.linalg.eigvalsh(corr)[-1], rtol=0.02)
    assert np.ptp(np.linalg.eigvalsh(unit)[:-1]) < 0.3 * np.ptp(np.linalg.eigvalsh(corr)[:-1])


def test_tilted_weights_are_proportional_to_their_utility():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 40):
        for aversion in (0.5, 5.0, 500.0):
            cov = np.cov(rng.normal(0, 0.02, (3 * n + 5, n)), rowvar=False).reshape(n, n)
            s = rng.dirichlet(np.ones(n))
            w = N.tilted_min_variance(cov, s, aversion)
            utility = s - aversion * cov @ w
            held = w > 0
            assert np.isclose(w.sum(), 1) and (w >= 0).all()
            k = utility[held] @ w[held] / (w[held] @ w[held])
            assert np.allclose(utility[held], k * w[held], atol=1e-8) and (utility[~held] <= 1e-8).all()


def test_denoised_weights_fall_back_without_history(spark):
    picked, _ = _candidates(spark, days=3)
    prices = spark.createDataFrame([("N000", D(2023, 12, 30), 1.0)],
                                   "internal_company_id string, date date, adjusted_close double")
    a = N.denoised_weights(picked, prices, "internal_company_id", RULES).toPandas()
    b = W.inverse_vol_weights(picked, RULES).toPandas()
    key = ["as_of", "internal_company_id"]
    m = a.merge(b, on=key)
    assert len(m) == len(a) == len(b) and np.allclose(m.weight_x, m.weight_y)


def test_metrics_and_overlays(spark):
    rng = np.random.default_rng(6)
    r = rng.normal(0.001, 0.02, 300)
    df = spark.createDataFrame([("p", D(2020, 1, 1) + dt.timedelta(days=i), i, float(x)) for i, x in enumerate(r)],
                               "portfolio string, date date, seq int, net_return double")
    s = P.performance_summary(df, ["portfolio"], "net_return").first()
    eq = np.cumprod(1 + r)
    annual = eq[-1] ** (252 / 300) - 1
    assert np.isclose(s.annualized_return, annual)
    assert np.isclose(s.sharpe, annual / (r.std(ddof=1) * 252 ** 0.5))
    assert np.isclose(s.max_drawdown, (eq / np.maximum.accumulate(eq) - 1).min())
    assert np.isclose(s.sortino, annual / (np.minimum(r, 0).std(ddof=1) * 252 ** 0.5))

    got = [x.vol_scale for x in O.vol_scale(df).orderBy("seq").collect()]
    prev = 1.0
    for t in range(300):
        new = 1.0
        if t > 20:
            new = 0.7 * prev + 0.3 * np.clip(0.15 / (r[max(0, t - 60):t].std(ddof=1) * 252 ** 0.5), 0.2, 1.2)
        assert np.isclose(got[t], new, atol=1e-12)
        prev = new
    got = [x.drawdown_scale for x in O.drawdown_scale(df).orderBy("seq").collect()]
    prev = 1.0
    for t in range(300):
        new = 1.0
        if t > 20:
            e = np.cumprod(1 + r[max(0, t - 252):t])
            dd = 1 - e[-1] / e.max()
            new = 0.5 * prev + 0.5 * (1.0 if dd <= 0.1 else max(0.3, 1 - (dd - 0.1) / 0.1))
        assert np.isclose(got[t], new, atol=1e-12)
        prev = new


@pytest.mark.parametrize("column,fn", [("vov_scale", O.vol_of_vol_scale), ("cluster_scale", O.cluster_scale)])
def test_state_scales_match_definitions(spark, column, fn):
    rng = np.random.default_rng(7)
    r = rng.normal(0, 0.01, 420) * np.where(np.arange(420) > 350, 2.5, 1.0)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(r)], "seq int, net_return double")
    got = [x[column] for x in fn(df).orderBy("seq").collect()]

    def damp(z):
        return float(np.clip(np.exp(-max(0.0, z) / 2.0), 0.3, 1.0))

    def target(past):
        s = pd.Series(past)
        if column == "vov_scale":
            if len(s) <= 80 or len(s) < 85:
                return 1.0
            v = s.rolling(20, min_periods=5).std().rolling(60, min_periods=10).std().dropna()
            return 1.0 if len(v) < 20 else damp((v.iloc[-1] - v.iloc[:-1].mean()) / v.iloc[:-1].std())
        if len(s) < 317:
            return 1.0
        sigma = s.rolling(60, min_periods=10).std()
        counts = [int((s.iloc[max(0, i - 60):i] < -sigma.iloc[i - 1]).sum()) if i >= 65 else 0
                  for i in range(len(s) - 252, len(s) + 1)]
        h = pd.Series(counts[:-1])
        return 1.0 if h.std() < 1e-12 else damp((counts[-1] - h.mean()) / h.std())

    prev = 1.0
    for t in range(420):
        new = 0.5 * prev + 0.5 * target(r[:t]) if t > 20 else 1.0
        assert np.isclose(got[t], new, atol=1e-9), (t, got[t], new)
        prev = new


def test_turnover_limit(spark):
    new = spark.createDataFrame([(D(2024, 1, 1), "a", 1.0)], "as_of date, internal_company_id string, weight double")
    old = spark.createDataFrame([(D(2024, 1, 1), "b", 1.0)], "as_of date, internal_company_id string, weight double")
    got = {r.internal_company_id: r.weight for r in W.limit_turnover(new, old, 0.25).collect()}
    assert got == {"a": 0.25, "b": 0.75}


def test_decayed_candidates_from_intervals_equal_every_day_ranked(spark):
    rng = np.random.default_rng(11)
    c = cal.calendar_between(spark, "2023-12-20", "2025-06-30").localCheckpoint()
    days = cal.trading_days(c).localCheckpoint()
    dates = [r.date for r in c.orderBy("date").collect()]
    rows = []
    for e in range(60):
        at = int(rng.integers(-260, 200))
        for k in range(3):
            length = int(rng.integers(1, 330))
            signal = [0.9, 0.5, 0.5, 0.06, -0.4, None, float(rng.uniform(0.05, 1))][int(rng.integers(7))]
            entry, leave = (dates[0] + dt.timedelta(days=x) for x in (at, at + length))
            rows.append((f"p{e}-{k}", f"e{e:02d}", "ab"[e % 2], entry, leave, signal))
            at += length + int(rng.integers(0, 20))
    preds = spark.createDataFrame(rows, "sample_id string, internal_company_id string, market_id string, entry_date date, exit_date date, "
                                        "predicted_signal double")
    seqs = days.count()
    vols = spark.createDataFrame([(m, s, None if (s // 30) % 5 == 4 and m == "a" else 0.01 + s / 1e4) for m in "ab" for s in range(3, seqs)],
                                 "market_id string, seq int, vol_estimate double")
    rules = C.PortfolioRules(max_positions=7)
    pieces = C.active_pieces(preds, c, days).localCheckpoint()
    for limits in ({}, {"floor": 0.0}, {"tau": 20.0, "floor": 0.3, "max_age": 15}):
        active = C.with_risk(C.active_by_day(preds, c, days), vols, "market_id")
        want = C.select_candidates(C.with_decayed_signal(active, **limits), rules)
        got = C.decayed_candidates_by_day(pieces, vols, "market_id", c, days, rules, **limits)
        assert sorted(got.columns) == sorted(want.columns)
        wanted = {tuple(r) for r in want.collect()}
        assert wanted and {tuple(r) for r in got.select(*want.columns).collect()} == wanted
        assert got.count() == len(wanted)
