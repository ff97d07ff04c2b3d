"""Trading calendar rules, as-of lookups and forward fills."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventide.operators import asof
from eventide.operators import calendar as cal
from eventide.session import materialize

D = dt.date


def test_known_holidays(spark):
    open_days = {r.date for r in cal.calendar_between(spark, "2020-12-20", "2022-12-31")
                 .where("is_trading_day").collect()}
    closed = [D(2020, 12, 25), D(2021, 1, 1), D(2021, 1, 18), D(2021, 2, 15), D(2021, 4, 2),
              D(2021, 5, 31), D(2021, 6, 18), D(2021, 7, 5), D(2021, 9, 6), D(2021, 11, 25),
              D(2021, 12, 24), D(2022, 4, 15), D(2022, 6, 20)]
    assert not open_days & set(closed)
    assert {D(2021, 4, 5), D(2021, 11, 26), D(2022, 7, 5)} <= open_days


def test_easter_over_a_century(spark):
    # Published dates of Easter Sunday.
    known = {1943: D(1943, 4, 25), 1961: D(1961, 4, 2), 1981: D(1981, 4, 19), 2000: D(2000, 4, 23),
             2008: D(2008, 3, 23), 2011: D(2011, 4, 24), 2038: D(2038, 4, 25)}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select(
        "y", cal.easter_sunday(F.col("y")).alias("d")).collect()
    assert {r.y: r.d for r in rows} == known


def test_neighbours_and_counts(spark):
    c = cal.calendar_between(spark, "2024-01-01", "2024-01-31")
    df = spark.createDataFrame([(D(2024, 1, 13), D(2024, 1, 16)), (D(2024, 1, 31), D(2024, 1, 31))],
                               "a date, b date")
    out = cal.with_neighbour(df, c, "a", "nxt", "next")
    out = cal.with_neighbour(out, c, "a", "prv", "previous")
    out = cal.with_trading_days_between(out, c, "a", "b", "n")
    rows = sorted(out.collect(), key=lambda r: r.a)
    assert (rows[0].nxt, rows[0].prv, rows[0].n) == (D(2024, 1, 16), D(2024, 1, 12), 1)
    assert rows[1].nxt is None and rows[1].n == 1  # calendar edge


def test_calendar_of_given_dates_and_bound(spark):
    c = cal.calendar_of_dates(spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 6),)], "date date"))
    assert [r.date for r in c.where("is_trading_day").orderBy("date").collect()] == [
        D(2024, 1, 2), D(2024, 1, 6)]
    with pytest.raises(Exception, match="calendar range"):
        cal.calendar_between(spark, "1000-01-01", "2024-01-01").count()


def test_asof_strict_inclusive_and_null_rows(spark):
    right = spark.createDataFrame([("k", D(2024, 1, 1), 1.0), ("k", D(2024, 1, 3), None)],
                                  "k string, d date, v double")
    left = spark.createDataFrame([("k", D(2024, 1, i)) for i in (1, 2, 3, 4)] + [("x", D(2024, 1, 2))],
                                 "k string, at date")
    get = lambda strict: {(r.k, r.at.day): r.v for r in asof.asof_lookup(
        left, right, ["k"], "at", "d", ["v"], strict=strict).collect()}
    assert get(True) == {("k", 1): None, ("k", 2): 1.0, ("k", 3): 1.0, ("k", 4): None, ("x", 2): None}
    assert get(False)[("k", 1)] == 1.0 and get(False)[("k", 3)] is None


def test_asof_answers_of_few_keys_leave_the_left_rows_in_place(spark):
    left = spark.range(2_000_000).select(F.lit("k").alias("k"), F.date_add(F.lit(D(2024, 1, 1)), (F.col("id") % 300).cast("int")).alias("at"),
                                         F.col("id").cast("string").alias("note"))
    right = spark.createDataFrame([("k", D(2024, 1, 1), 1.0), ("k", D(2024, 3, 1), 2.0)], "k string, d date, v double")
    out = asof.asof_lookup(left, right, ["k"], "at", "d", ["v"], strict=False, stage=materialize)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert out.where("v = 1").select("at").distinct().count() == 60 and out.count() == 2_000_000


def test_filled_grid_carries_forward_only(spark):
    c = cal.calendar_between(spark, "2024-01-02", "2024-01-09")
    days = cal.trading_days(c)
    px = spark.createDataFrame([("a", D(2024, 1, 3), 5.0), ("a", D(2024, 1, 6), 9.0),
                                ("a", D(2024, 1, 8), 7.0)], "k string, date date, p double")
    got = {r.date.day: r.p for r in asof.filled_grid(px, days, "k", ["p"]).collect()}
    assert got == {2: None, 3: 5.0, 4: 5.0, 5: 5.0, 8: 7.0, 9: 7.0}  # Saturday's 9.0 is off the calendar
