"""Event samples, scales and fact cells on a tiny world, including future perturbation."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from eventide.operators import calendar as cal
from eventide.operators import events as E
from eventide.operators import feature_encoding as fe
from eventide.operators import scale_target as ST
from eventide.operators import universe as U

D, T = dt.date, dt.datetime
A = "COMP0000000001"


@pytest.fixture(scope="module")
def world(spark):
    filings = spark.createDataFrame([
        ("e1", A, T(2024, 1, 5, 18), "10-Q"), ("e1b", A, T(2024, 1, 5, 9), "10-K"),
        ("e2", A, T(2024, 2, 3, 9), "10-Q"), ("e3", A, T(2024, 2, 6, 9), "10-Q"),
        ("e4", A, T(2024, 3, 28, 9), "10-Q"), ("one", "COMP0000000002", T(2024, 1, 9), "10-Q")],
        "filing_event_id string, internal_company_id string, accepted_datetime timestamp, form_type string")
    calendar = cal.calendar_between(spark, "2024-01-02", "2024-03-29")
    days = [r.date for r in calendar.where("is_trading_day").orderBy("date").collect()]
    prices = spark.createDataFrame([(A, d, 100.0 + i, 10.0) for i, d in enumerate(days)],
                                   "internal_company_id string, date date, adjusted_close double, volume double")
    return filings, prices, calendar, days


def test_samples_and_reasons(world):
    filings, prices, calendar, days = world
    s, x = E.build_event_samples(filings, prices, calendar, train_end="2024-01-31",
                                 validation_end="2024-12-31")
    rows = {r.filing_event_id: r for r in s.collect()}
    assert set(rows) == {"e1b", "e3"}  # the annual form wins its day
    first = rows["e1b"]
    assert (first.entry_date, first.exit_date) == (D(2024, 1, 8), D(2024, 2, 2))
    p = {d: 100.0 + i for i, d in enumerate(days)}
    assert math.isclose(first.raw_log_return, math.log(p[D(2024, 2, 2)] / p[D(2024, 1, 8)]))
    assert first.split == "train" and rows["e3"].split == "validation"
    assert first.holding_days == days.index(D(2024, 2, 2)) - days.index(D(2024, 1, 8)) + 1
    reasons = {r.filing_event_id: r.exclusion_reason for r in x.collect()}
    assert reasons == {"e1": E.DUPLICATE, "e2": E.ENTRY_AFTER_EXIT, "e4": E.NO_NEXT_EVENT,
                       "one": E.NO_NEXT_EVENT}


def test_missing_prices_are_reported(world):
    filings, prices, calendar, _ = world
    gap = prices.where(F.col("date") != D(2024, 1, 8))
    _, x = E.build_event_samples(filings, gap, calendar, train_end="2024-01-31",
                                 validation_end="2024-12-31")
    assert {r.filing_event_id: r.exclusion_reason for r in x.collect()}["e1b"] == E.NO_ENTRY_PRICE


def test_open_and_live(world):
    filings, prices, calendar, days = world
    opened = {r.filing_event_id: r for r in E.build_open_samples(filings, prices, calendar,
                                                                 holding=5).collect()}
    assert opened == {} or "e4" not in opened  # no trading day after 28 March but Good Friday
    live = E.build_live_samples(filings, prices, calendar, as_of="2024-02-04", holding=3).collect()
    assert [r.filing_event_id for r in live] == ["e2"]
    assert live[0].entry_date == D(2024, 2, 5) and live[0].sample_id.endswith("_LIVE")


def _samples(spark, returns, start=D(2024, 1, 1)):
    rows = [(f"s{i}", A, start + dt.timedelta(days=30 * i), float(r), 20, True, None)
            for i, r in enumerate(returns)]
    return spark.createDataFrame(rows, "sample_id string, internal_company_id string, entry_date date, "
                                 "raw_log_return double, holding_days int, eligible_for_training boolean, "
                                 "exclusion_reason string")


def test_event_vol_is_robust_and_past_only(spark):
    r = [0.1, -0.2, 0.3, 0.05, 0.4, 0.1]
    got = [x.event_vol for x in ST.with_event_vol(_samples(spark, r), 8, 4).orderBy("entry_date").collect()]
    assert got[:4] == [None] * 4
    # median of the first four is .075, deviations .025 .275 .225 .025
    assert math.isclose(got[4], 1.4826 * 0.125)
    later = [x.event_vol for x in ST.with_event_vol(_samples(spark, r[:5] + [99.0]), 8, 4)
             .orderBy("entry_date").collect()]
    assert later[:6] == got[:6]
    flat = [x.event_vol for x in ST.with_event_vol(_samples(spark, [0.1] * 4 + [0.5, 0.1]), 8, 4)
            .orderBy("entry_date").collect()]
    assert flat[4] is None  # no spread at all
    assert math.isclose(flat[5], 0.17888543819998318)  # zero MAD falls back to the deviation


def test_targets(spark):
    s = _samples(spark, [0.1, 0.2, 0.2, -0.1]).withColumn(
        "entry_date", F.lit("2024-02-01").cast("date")).withColumn("ex_ante_scale", F.lit(0.1))
    s = s.unionByName(s.limit(1).withColumn("sample_id", F.lit("none")).withColumn(
        "ex_ante_scale", F.lit(None).cast("double")))
    rank = {r.sample_id: r for r in ST.with_target(s, "cross_sectional_rank").collect()}
    assert rank["s3"].target_normalized_signal == -0.5
    assert rank["s1"].target_normalized_signal == rank["s2"].target_normalized_signal == 0.75
    assert rank["none"].target_normalized_signal is None
    assert rank["none"].exclusion_reason == "missing_ex_ante_scale"
    assert rank["none"].eligible_for_training is False
    tanh = {r.sample_id: r.target_normalized_signal for r in ST.with_target(s).collect()}
    assert math.isclose(tanh["s0"], math.tanh(0.1 / 0.25))


FACT = ("internal_company_id string, anonymous_feature_id string, period_end_date date, form_type string, "
        "accepted_date date, value double, fiscal_period string, fact_id bigint")


def _facts(spark, extra=()):
    rows = [(A, "f0", D(2023, 3 * q, 28), "10-Q", D(2023, 3 * q, 28) + dt.timedelta(days=20),
             float(q), f"Q{q}", q) for q in (1, 2, 3, 4)]
    rows += [(A, "f0", D(2023, 3, 28), "10-K", D(2023, 12, 1), 100.0, "FY", 50),
             (A, "f0", D(2023, 6, 28), "8-K", D(2023, 11, 1), 55.0, "Q2", 51)]
    return spark.createDataFrame(rows + list(extra), FACT)


def _asked(spark, day):
    return spark.createDataFrame([("s", A, day, T(day.year, day.month, day.day, 17))],  # noon in New York
                                 "sample_id string, internal_company_id string, entry_date date, accepted_datetime timestamp")


def test_fact_versions_and_offsets(spark):
    cells = lambda day, p=8, extra=(): {
        r.period_offset: r.value for r in fe.fact_cells(
            _asked(spark, day), fe.fact_versions(_facts(spark, extra)), p).collect()}
    assert cells(D(2023, 7, 17)) == {0: 1.0}
    assert cells(D(2023, 7, 18)) == {0: 2.0, 1: 1.0}         # accepted on the day itself counts
    assert cells(D(2023, 12, 31)) == {0: 3.0, 1: 2.0, 2: 100.0}  # annual form beats, 8-K does not
    assert cells(D(2024, 2, 1), p=2) == {0: 4.0, 1: 3.0}
    future = [(A, "f0", D(2023, 6, 28), "10-K", D(2024, 1, 5), 9.0, "FY", 60)]
    assert cells(D(2023, 12, 31), extra=future) == cells(D(2023, 12, 31))


def test_cells_move_once_per_entity(spark):
    """Versions are shuffled once, by entity; periods, their ranks and the cells stay there."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = fe.fact_cells(_asked(spark, D(2023, 7, 18)), fe.fact_versions(_facts(spark)))
        plan = cells._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.value for r in cells.collect()) == [1.0, 2.0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Raw facts to their versions, versions to their entity, samples to their entity.
    assert plan.count("Exchange hashpartitioning") == 3


def test_undated_periods_have_no_cells(spark):
    undated = (A, "f0", None, "10-Q", D(2023, 1, 5), 7.0, "Q1", 70)
    asked = _asked(spark, D(2023, 7, 18)).withColumn("note", F.lit("kept"))
    cells = fe.fact_cells(asked, fe.fact_versions(_facts(spark, [undated])), keep=["note"]).collect()
    assert sorted((r.period_offset, r.value, r.note) for r in cells) == [(0, 2.0, "kept"), (1, 1.0, "kept")]


def test_late_old_periods_do_not_hide_newer(spark):
    """Periods becoming visible out of order still give the newest visible ones."""
    rows = [(A, "f0", D(2020, m, 1), "10-Q", D(2021, a, 1), float(m), "Q1", m)
            for m, a in ((1, 9), (2, 3), (3, 8), (4, 1), (5, 7), (6, 2))]
    versions = fe.fact_versions(spark.createDataFrame(rows, FACT))
    for month in range(1, 11):
        day = D(2021, month, 15)
        got = [r.value for r in fe.fact_cells(_asked(spark, day), versions, 2)
               .orderBy("period_offset").collect()]
        want = sorted((float(m) for m, a in ((1, 9), (2, 3), (3, 8), (4, 1), (5, 7), (6, 2))
                       if a <= month), reverse=True)[:2]
        assert got == want


def test_derived_cells(spark):
    df = spark.createDataFrame([("s", p, "f", v) for p, v in enumerate([5.0, 4.0, 3.0, 2.0, 1.0])],
                               "sample_id string, period_offset int, anonymous_feature_id string, value double")
    got = {r.anonymous_feature_id: r.value for r in fe.derived_cells(df).collect()}
    assert got["derived_yoy_f"] == 4.0 and math.isclose(got["derived_z_f"], 2 / math.sqrt(2.5))
    gap = {r.anonymous_feature_id for r in fe.derived_cells(df.where("period_offset <> 4")).collect()}
    assert gap == {"derived_z_f"}


def test_feature_map_is_stable_when_extended(spark):
    rows = [(f"C{i}", "t", c, "USD", D(2023, 1, 1)) for c in ("b", "d") for i in range(3)]
    schema = "internal_company_id string, taxonomy string, concept_name string, unit string, accepted_date date"
    known = fe.fit_feature_map(spark.createDataFrame(rows, schema), min_companies=2)
    more = rows + [(f"C{i}", "t", "a", "USD", D(2023, 1, 1)) for i in range(3)]
    refit = fe.fit_feature_map(spark.createDataFrame(more, schema), min_companies=2)
    ids = {r.concept_name: r.anonymous_feature_id for r in fe.extend_feature_map(known, refit).collect()}
    assert ids == {"b": "feature_000000", "d": "feature_000001", "a": "feature_000002"}


def test_sample_filter_reasons(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(120)]
    px = [("liquid", d, 50.0, 1e6) for d in days] + [("cheap", d, 1.0, 1e9) for d in days]
    px += [("thin", d, 50.0, 1.0) for d in days] + [("short", d, 50.0, 1e6) for d in days[-5:]]
    prices = spark.createDataFrame(px, "k string, date date, adjusted_close double, volume double")
    samples = spark.createDataFrame([(k, k, days[-1]) for k in ("liquid", "cheap", "thin", "short", "gone")],
                                    "sample_id string, k string, entry_date date")
    rules = U.UniverseRules(min_dollar_volume=1e6, min_years=0.2)
    kept, dropped = U.apply_sample_filter(samples, prices, "k", rules)
    assert [r.sample_id for r in kept.collect()] == ["liquid"]
    assert {r.sample_id: r.exclusion_reason for r in dropped.collect()} == {
        "cheap": U.LOW_PRICE, "thin": U.LOW_VOLUME, "short": U.SHORT_HISTORY, "gone": U.NO_SERIES}
