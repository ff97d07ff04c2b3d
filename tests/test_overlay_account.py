"""Scaled weights through an accounting of their own, against a day by day recount."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.operators import accounting as A
from eventide.operators import overlays as O

DAYS = [dt.date(2024, 1, d) for d in range(2, 12)]
PRICE = {"x": [10, 11, 12, 11, 13, 14, 13, 15, 16, 15], "y": [20, 19, 21, 22, 20, 23, 24, 23, 25, 24]}
STARTS = {0: {"x": 0.5, "y": 0.3}, 4: {"x": 0.2, "y": 0.6}}


def _inputs(spark):
    days = spark.createDataFrame([(d, i) for i, d in enumerate(DAYS)], "date date, seq int")
    grid = spark.createDataFrame([(k, i, float(p)) for k, ps in PRICE.items() for i, p in enumerate(ps)],
                                 "internal_company_id string, seq int, adjusted_close double")
    targets = spark.createDataFrame([(DAYS[s], s, e, w, 1 - sum(ws.values())) for s, ws in STARTS.items() for e, w in ws.items()],
                                    "as_of date, seq int, internal_company_id string, weight double, cash_weight double")
    preds = spark.createDataFrame([(DAYS[0], DAYS[4])], "entry_date date, exit_date date")
    return targets, preds, grid, days


def _recount(scale):
    """Net return and cash per day of the scaled weights, holding amounts instead of weights."""
    held, cash, out = {}, 1.0, []
    for i in range(len(DAYS)):
        if i:
            before = sum(held.values()) + cash
            held = {k: v * PRICE[k][i] / PRICE[k][i - 1] for k, v in held.items()}
            gross = (sum(held.values()) + cash) / before - 1
        else:
            gross = 0.0
        worth, cost = sum(held.values()) + cash, 0.0
        if i in STARTS:
            new = {k: w * scale[i] for k, w in STARTS[i].items()}
            cost = sum(abs(new[k] - held.get(k, 0.0) / worth) for k in new) * 0.001
            held, cash = {k: w * worth for k, w in new.items()}, (1 - sum(new.values())) * worth
            worth = sum(held.values()) + cash
        out.append((gross - cost, cash / worth))
    return out


@pytest.mark.parametrize("first, second", [(0.5, 0.8), (1.5, 1.4), (0.0, 1.0)])
def test_scaled_weights_trade_and_borrow_on_their_own(spark, first, second):
    targets, preds, grid, days = _inputs(spark)
    scales = spark.createDataFrame([(DAYS[0], first, 1.0), (DAYS[4], second / 0.5, 0.5)], "date date, a double, b double")
    daily = O.account_scaled(targets, scales, ("a", "b"), preds, grid, days)["daily"].orderBy("seq").collect()
    want = _recount({0: first, 4: second})
    assert [(r.net_return, r.cash_weight) for r in daily] == [pytest.approx(w, abs=1e-12) for w in want]


def test_scales_of_one_or_none_change_nothing(spark):
    targets, preds, grid, days = _inputs(spark)
    none = spark.createDataFrame([(DAYS[0], None)], "date date, a double")
    plain = A.account(targets, preds, grid, days)["daily"].orderBy("seq").collect()
    scaled = O.account_scaled(targets, none, ("a",), preds, grid, days)["daily"].orderBy("seq").collect()
    assert [r.net_return for r in scaled] == pytest.approx([r.net_return for r in plain])
    assert O.apply_scale(targets, none.withColumn("a", F.lit(2.0)), "a").agg(F.min("cash_weight")).first()[0] == 0.0
