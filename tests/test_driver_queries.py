"""A cross-section of registered queries against DuckDB on the smallest tables."""

import datetime as dt

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as entry
from eventide.operators import gates as G

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
spec = importlib.util.spec_from_file_location("check", os.path.join(ROOT, "tools", "check_oracles.py"))
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

NAMES = ["trading_calendar", "event_samples", "event_exclusions", "ex_ante_scale", "sector_rank_target",
         "sample_liquidity_filter", "pit_fact_periods", "robust_scaled_features", "entity_moments",
         "inverse_vol_weights", "portfolio_daily", "portfolio_trades", "performance_summary", "decile_table",
         "quarterly_ic", "rank_ensemble", "parsed_events", "stream_dedupe"]


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = check.text_rows(got), check.text_rows(want)
    assert len(a) == len(b) and (a == b).all()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_gates_fail_on_bad_rows(spark):
    bad = spark.createDataFrame([(1.5,), (0.2,)], "predicted_signal double")
    gates = G.all_gates([G.in_range(bad, "predicted_signal", "range"),
                         G.anonymous_columns(spark.createDataFrame([(1, 1)], "net_revenue int, meta_cash int"))])
    assert {r.gate: r.violations for r in gates.collect()} == {"range": 1, "anonymous_columns": 1}
    with pytest.raises(G.GateFailure, match="range"):
        G.require(gates)


def test_top_lists_limit_before_the_shuffle(spark, sf_dir):
    """Candidate selection must cut each day inside the tasks, not after moving it."""
    from eventide.driver import views as V
    from eventide.operators.candidates import select_candidates
    plan = select_candidates(V.active(spark, sf_dir), V.RULES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan


def test_lines_are_summed_by_market(spark, tmp_path):
    """Prices shuffle a row per market and day and task, not a row per supplier and day."""
    from eventide.driver import views as V

    lines = [(s, dt.datetime(1995, 1, 1 + k % 3), 10.0 * k + (s or 9), 1.0 + (s or 9)) for k in range(6) for s in (1, 2, 3, None)]
    spark.createDataFrame(lines, "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 7), (2, 7), (3, 8), (4, 8)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(7, 0), (8, 0)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    of = {1: "7", 2: "7", 3: "8"}
    for level, market in (("region", lambda s: "MKT0"), ("supplier", lambda s: f"MKT{s}")):
        prices = V.daily_prices(spark, str(tmp_path), level)
        want = {}
        for s, d, p, q in lines:
            if s in of:
                total = want.setdefault((market(s), d.date()), [0.0, 0.0])
                total[0] += p
                total[1] += q
        got = {(r.market_id, r.date): (r.adjusted_close, r.volume) for r in prices.collect()}
        assert got == {k: (pytest.approx(p / q), pytest.approx(q)) for k, (p, q) in want.items()}
    plan = V.daily_prices(spark, str(tmp_path), "region")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(market_id" in plan and "hashpartitioning(l_suppkey" not in plan
