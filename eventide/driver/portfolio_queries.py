"""Accounting, overlays, benchmarks, performance and attribution."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.market_queries import sd, z
from eventide.driver.registry import big, day, num, query, sig_nine
from eventide.driver.sql import r
from eventide.driver.weight_queries import PICK
from eventide.functions import rolling as R
from eventide.operators import accounting as A
from eventide.operators import market_features as mf
from eventide.operators import overlays as O
from eventide.operators import performance as P
from eventide.operators import weights as W
from eventide.session import materialize

Q.fragment("tgt", "SELECT t.*, s.seq, p.mkt, greatest(0, 1 - sum(t.w) OVER (PARTITION BY t.date)) AS cash FROM target t JOIN tds s USING (date) JOIN pick p USING (date, ent)")
Q.fragment("marks", """
SELECT date, seq, date IN (SELECT en FROM pred UNION SELECT ex FROM pred) AS trig,
  date IN (SELECT date FROM target) AS fill FROM tds""")
Q.fragment("segs", "SELECT *, sum(trig::INT) OVER (ORDER BY seq) AS seg FROM marks")
Q.fragment("reb", """
SELECT date, seq, lead(seq) OVER (ORDER BY seq) AS nxt FROM (
  SELECT *, fill AND coalesce(sum(fill::INT) OVER (PARTITION BY seg ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS ff
  FROM segs) WHERE trig OR ff""")
Q.fragment("dri", """
SELECT s0, seq, ent, mkt, g / (sum(g) OVER p + cash) AS w, sum(g) OVER p + cash AS growth, cash / (sum(g) OVER p + cash) AS cashw, nxt
FROM (SELECT r.seq AS s0, r.nxt, t.seq, g.ent, g.mkt, g.cash, g.w * coalesce(b.px / a.px, 1) AS g
  FROM tgt g JOIN reb r ON r.seq = g.seq
  JOIN tds t ON t.seq BETWEEN r.seq AND coalesce(r.nxt, (SELECT max(seq) FROM tds))
  LEFT JOIN grid a ON a.mkt = g.mkt AND a.seq = r.seq LEFT JOIN grid b ON b.mkt = g.mkt AND b.seq = t.seq)
WINDOW p AS (PARTITION BY s0, seq)""")
Q.fragment("trd", """
SELECT * FROM (SELECT seq, ent, sum(o) AS o, sum(n) AS n FROM (
  SELECT g.seq, ent, 0 AS o, w AS n FROM tgt g JOIN reb USING (seq)
  UNION ALL SELECT seq, ent, w, 0 FROM dri WHERE seq = nxt) GROUP BY 1, 2) WHERE abs(n - o) > 1e-9""")
Q.fragment("hold", "SELECT t.date, d.seq, ent, mkt, w FROM dri d JOIN tds t USING (seq) WHERE nxt IS NULL OR d.seq < nxt")
Q.fragment("gross", """
SELECT seq, gr FROM (SELECT s0, seq, growth / lag(growth) OVER (PARTITION BY s0 ORDER BY seq) - 1 AS gr FROM (
  SELECT s0, seq, max(growth) AS growth FROM dri GROUP BY 1, 2)) WHERE gr IS NOT NULL""")
Q.fragment("daily", """
SELECT t.date, t.seq, coalesce(gr, 0) AS gross, coalesce(c, 0) AS cost, coalesce(gr, 0) - coalesce(c, 0) AS net,
  coalesce(cw, 1) AS cash, coalesce(n, 0) AS n, coalesce(tov, 0) AS tov,
  exp(sum(ln(1 + coalesce(gr, 0) - coalesce(c, 0))) OVER (ORDER BY t.seq)) AS val
FROM tds t LEFT JOIN gross USING (seq)
LEFT JOIN (SELECT seq, sum(abs(n - o)) / 2 AS tov, sum(abs(n - o)) * 0.001 AS c FROM trd GROUP BY 1) USING (seq)
LEFT JOIN (SELECT seq, max(cashw) AS cw, count(*) AS n FROM dri WHERE nxt IS NULL OR seq < nxt GROUP BY 1) USING (seq)""")
# The grid of market_queries, then accounting on the capped weights.
ACCOUNT = PICK + " target grid tgt marks segs reb dri trd hold gross daily"


def accounted(body: str, more: str = "") -> str:
    return Q.with_(ACCOUNT + (" " + more if more else ""), body)


@query("portfolio_daily", accounted(f"""
SELECT date::VARCHAR AS date, {r('gross')} AS gross_return, {r('cost')} AS transaction_cost_return,
  {r('net')} AS net_return, {r('val')} AS portfolio_value, {r('cash')} AS cash_weight, n::BIGINT AS n_positions,
  {r('tov')} AS turnover FROM daily"""))
def portfolio_daily(spark, d):
    p = V.portfolio(spark, d)["daily"]
    return p.select(day("date").alias("date"), num("gross_return").alias("gross_return"),
                    num("transaction_cost_return").alias("transaction_cost_return"),
                    num("net_return").alias("net_return"),
                    num("portfolio_value").alias("portfolio_value"),
                    num("cash_weight").alias("cash_weight"),
                    big("n_positions").alias("n_positions"), num("turnover").alias("turnover"))


@query("portfolio_trades", accounted(f"""
SELECT date::VARCHAR AS date, ent AS internal_company_id, {r('o')} AS old_weight, {r('n')} AS new_weight,
  {r('abs(n - o) * 0.001', 9)} AS trade_cost,
  CASE WHEN o > 0 AND n > 0 THEN 'rebalance' WHEN n > 0 THEN 'new_signal' ELSE 'exit' END AS reason
FROM trd JOIN tds USING (seq)"""))
def portfolio_trades(spark, d):
    return V.portfolio(spark, d)["trades"].select(
        day("date").alias("date"), "internal_company_id", num("old_weight").alias("old_weight"),
        num("new_weight").alias("new_weight"), num("trade_cost", 9).alias("trade_cost"), "reason")


@query("portfolio_holdings", accounted(f"""
SELECT date::VARCHAR AS date, ent AS internal_company_id, {r('w')} AS weight FROM hold"""))
def portfolio_holdings(spark, d):
    return V.portfolio(spark, d)["holdings"].select(
        day("date").alias("date"), "internal_company_id", num("weight").alias("weight"))


Q.fragment("bst", """
SELECT *, CASE WHEN v > 0 THEN 1 / v END AS iv FROM (
  SELECT mkt, date, seq, rt, CASE WHEN count(rt) OVER w >= 63 THEN stddev_samp(rt) OVER w END AS v,
    CASE WHEN count(px) OVER w >= 63 THEN avg(px * vol) OVER w END AS dv
  FROM (SELECT *, coalesce(px / lag(px) OVER (PARTITION BY mkt ORDER BY seq) - 1, 0) AS rt FROM grid)
  WINDOW w AS (PARTITION BY mkt ORDER BY seq ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))""")
Q.fragment("bact", """
SELECT l.date, l.seq, l.ent, l.sig, b.rt, b.iv FROM live l JOIN bst b ON b.mkt = l.mkt AND b.seq = l.seq""")
Q.fragment("bpair", """
SELECT ent, seq, date, coalesce(iv / sum(iv) OVER (PARTITION BY seq), 0) AS w FROM bact""")
Q.fragment("bcost", """
SELECT coalesce(a.seq, b.seq + 1) AS seq, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 * 0.001 AS c
FROM bpair a FULL JOIN bpair b ON a.ent = b.ent AND a.seq = b.seq + 1 GROUP BY 1""")
Q.fragment("ball", """
SELECT 'equal_weight' AS p, date, sum(rt) / (SELECT count(DISTINCT mkt) FROM px_nation) AS ret FROM bst GROUP BY 2
UNION ALL SELECT 'inverse_vol', date, coalesce(sum(iv * rt) / sum(iv), 0) FROM bst GROUP BY 2
UNION ALL SELECT 'dollar_volume', date, coalesce(sum(dv * rt) / sum(dv), 0) FROM bst GROUP BY 2
UNION ALL SELECT 'equal_weight_active', date, coalesce(x, 0) FROM tds LEFT JOIN (SELECT date, avg(rt) AS x FROM bact GROUP BY 1) USING (date)
UNION ALL SELECT 'inverse_vol_active', date, coalesce(x, 0) FROM tds LEFT JOIN (SELECT date, coalesce(sum(iv * rt) / sum(iv), 0) AS x FROM bact GROUP BY 1) USING (date)
UNION ALL SELECT 'inverse_vol_active_10bps', date, coalesce(x, 0) - coalesce(c, 0) FROM tds LEFT JOIN (SELECT date, coalesce(sum(iv * rt) / sum(iv), 0) AS x FROM bact GROUP BY 1) USING (date) LEFT JOIN bcost USING (seq)
UNION ALL SELECT 'random_n', date, coalesce(x, 0) FROM tds LEFT JOIN (SELECT date, coalesce(sum(iv * rt) / sum(iv), 0) AS x FROM (
  SELECT * FROM bact QUALIFY row_number() OVER (PARTITION BY date ORDER BY sha1('42|' || date::VARCHAR || '|' || ent), ent) <= 50) GROUP BY 1) USING (date)
UNION ALL SELECT 'shuffled_signal', date, coalesce(x, 0) FROM tds LEFT JOIN (SELECT date, coalesce(sum(iv * s * rt) / sum(iv * s), 0) AS x FROM (
  SELECT date, sig AS s, row_number() OVER (PARTITION BY date ORDER BY sig DESC, ent) AS k FROM bact WHERE sig > 0 QUALIFY k <= 50) JOIN (
  SELECT date, rt, iv, row_number() OVER (PARTITION BY date ORDER BY sha1('42|' || date::VARCHAR || '|' || ent), ent) AS k FROM bact) USING (date, k) GROUP BY 1) USING (date)
UNION ALL SELECT lower(sym), date, coalesce(px / lag(px) OVER (PARTITION BY sym ORDER BY date) - 1, 0) FROM index_px QUALIFY date IN (SELECT date FROM tds)
UNION ALL SELECT 'strategy', date, net FROM daily""")
BENCH = "px_region bst bact bpair bcost index_px ball"


def all_rows(spark, d, names):
    rows = V.all_returns(spark, d).where(F.col("portfolio").isin(names))
    return rows.select("portfolio", day("date").alias("date"), num("ret").alias("ret"))


_PLAIN = ["equal_weight", "inverse_vol", "dollar_volume", "equal_weight_active",
          "inverse_vol_active", "inverse_vol_active_10bps", "spy", "qqq"]
_RANDOM = ["random_n", "shuffled_signal"]


def _bench_sql(names):
    return accounted(f"""SELECT p AS portfolio, date::VARCHAR AS date, {r('ret')} AS ret FROM ball
WHERE p IN ({', '.join(repr(n) for n in names)})""", BENCH)


@query("benchmark_returns", _bench_sql(_PLAIN))
def benchmark_returns(spark, d):
    return all_rows(spark, d, _PLAIN)


@query("random_shuffled_benchmarks", _bench_sql(_RANDOM))
def random_shuffled_benchmarks(spark, d):
    return all_rows(spark, d, _RANDOM)


Q.fragment("eq", "SELECT p, date, ret, exp(sum(ln(1 + ret)) OVER (PARTITION BY p ORDER BY date)) AS e FROM ball")
Q.fragment("ddn", "SELECT *, e / max(e) OVER (PARTITION BY p ORDER BY date) - 1 AS dd FROM eq")
Q.fragment("summ", """
SELECT p, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS ar, stddev_samp(ret) * sqrt(252) AS av,
  stddev_samp(least(ret, 0)) * sqrt(252) AS dv, min(dd) AS mdd, count(*) AS n FROM ddn GROUP BY 1""")
PERF = BENCH + " eq ddn summ"


@query("performance_summary", accounted(f"""
SELECT p AS portfolio, {r('ar')} AS annualized_return, {r('av')} AS annualized_volatility,
  {r('CASE WHEN av = 0 THEN 0 ELSE ar / av END')} AS sharpe, {r('CASE WHEN dv = 0 THEN 0 ELSE ar / dv END')} AS sortino,
  {r('mdd')} AS max_drawdown, {r('CASE WHEN mdd = 0 THEN 0 ELSE ar / abs(mdd) END')} AS calmar, n::BIGINT AS n_days,
  {r("CASE WHEN p = 'strategy' THEN (SELECT avg(tov) * 252 FROM daily) ELSE 0 END")} AS annualized_turnover FROM summ""", PERF))
def performance_summary(spark, d):
    s = P.performance_summary(V.all_returns(spark, d), ["portfolio"], "ret", "turnover")
    return s.select("portfolio", big("n_days").alias("n_days"), *[num(c).alias(c) for c in (
        "annualized_return", "annualized_volatility", "sharpe", "sortino", "max_drawdown",
        "calmar", "annualized_turnover")])


@query("strategy_decision", accounted("""
SELECT 'strategy' AS portfolio, CASE WHEN NOT sh AND NOT ri THEN 'A' WHEN sh AND NOT dd THEN 'B'
  WHEN sh AND dd AND ri THEN 'C' ELSE 'borderline' END AS decision FROM (
  SELECT s.ar / s.av > b.ar / b.av AS sh, abs(s.mdd) <= abs(b.mdd) AS dd, s.ar > b.ar AS ri
  FROM summ s JOIN summ b ON s.p = 'strategy' AND b.p = 'inverse_vol_active')""", PERF))
def strategy_decision(spark, d):
    s = P.performance_summary(V.all_returns(spark, d), ["portfolio"])
    return P.decision_label(s, "strategy", "inverse_vol_active", "inverse_vol")


@query("drawdown_episodes", accounted(f"""
SELECT p AS portfolio, ep::BIGINT AS episode, coalesce(min(date) FILTER (WHERE dd >= -1e-9)::VARCHAR, '') AS peak_date, arg_min(date, dd)::VARCHAR AS trough_date,
  coalesce(last(nx ORDER BY date)::VARCHAR, '') AS recovery_date, {r('min(dd)')} AS depth, count(*) FILTER (WHERE dd < -1e-9)::BIGINT AS days_below
FROM (SELECT *, sum((dd >= -1e-9)::INT) OVER (PARTITION BY p ORDER BY date) AS ep, lead(date) OVER (PARTITION BY p ORDER BY date) AS nx FROM ddn)
GROUP BY 1, 2 HAVING min(dd) < -1e-9""", PERF))
def drawdown_episodes(spark, d):
    e = P.drawdown_episodes(V.all_returns(spark, d), "ret", ["portfolio"])
    blank = lambda c: F.coalesce(day(c), F.lit("")).alias(c)
    return e.select("portfolio", big("episode").alias("episode"), blank("peak_date"),
                    day("trough_date").alias("trough_date"), blank("recovery_date"),
                    num("depth").alias("depth"), big("days_below").alias("days_below"))


def _versus(spark, d):
    rows = V.all_returns(spark, d)
    b = rows.where(F.col("portfolio") == "equal_weight").select("date", F.col("ret").alias("bench"))
    return rows.join(b, "date")


@query("rolling_excess", accounted(f"""
SELECT a.p AS portfolio, a.date::VARCHAR AS date, {r(Q.sig_nine('x'))} AS rolling_excess FROM (
  SELECT a.p, a.date, CASE WHEN count(*) OVER w = 252 THEN exp(sum(ln(1 + a.ret)) OVER w) - exp(sum(ln(1 + b.ret)) OVER w) END AS x
  FROM ball a JOIN ball b ON a.date = b.date AND b.p = 'equal_weight'
  WINDOW w AS (PARTITION BY a.p ORDER BY a.date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) a""", BENCH))
def rolling_excess(spark, d):
    e = P.rolling_excess(_versus(spark, d), "ret", "bench", ["portfolio"])
    return e.select("portfolio", day("date").alias("date"), num(sig_nine("rolling_excess")).alias("rolling_excess"))


@query("monthly_hit_rate", accounted(f"""
SELECT p AS portfolio, {r('avg((x > y)::INT)')} AS hit_rate, count(*)::BIGINT AS months FROM (
  SELECT a.p, date_trunc('month', a.date) AS m, sum(ln(1 + a.ret)) AS x, sum(ln(1 + b.ret)) AS y
  FROM ball a JOIN ball b ON a.date = b.date AND b.p = 'equal_weight' GROUP BY 1, 2) GROUP BY 1""", BENCH))
def monthly_hit_rate(spark, d):
    h = P.monthly_hit_rate(_versus(spark, d), "ret", "bench", ["portfolio"])
    return h.select("portfolio", num("hit_rate").alias("hit_rate"), big("months").alias("months"))


@query("concentration", accounted(f"""
SELECT date::VARCHAR AS date, {r('sum(w * w)')} AS herfindahl, {r('sum(w) FILTER (WHERE k <= 5)')} AS top5_weight,
  {r('sum(w) FILTER (WHERE k <= 10)')} AS top10_weight, count(*)::BIGINT AS n_positions
FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, ent) AS k FROM hold) GROUP BY 1"""))
def concentration(spark, d):
    c = P.concentration(V.portfolio(spark, d)["holdings"])
    return c.select(day("date").alias("date"), num("herfindahl").alias("herfindahl"),
                    num("top5_weight").alias("top5_weight"), num("top10_weight").alias("top10_weight"),
                    big("n_positions").alias("n_positions"))


Q.fragment("ctb", """
SELECT h.ent, h.mkt, t.date, h.w * b.rt AS c, co.sector, co.segment FROM hold h
JOIN tds t ON t.seq = h.seq + 1 JOIN bst b ON b.mkt = h.mkt AND b.seq = h.seq + 1 JOIN co_nation co ON co.ent = h.ent""")


def _contributions(spark, d):
    held = V.portfolio(spark, d)["holdings"].join(V.entity_markets(spark, d), "internal_company_id")
    return P.daily_contributions(held, V.state(spark, d), V.days(spark, d), "market_id")


@query("attribution", accounted(f"""
SELECT ent AS internal_company_id, {r('sum(c)')} AS total_contribution FROM ctb GROUP BY 1
ORDER BY sum(c) DESC, ent LIMIT 20""", "bst ctb"))
def attribution(spark, d):
    return P.top_contributors(_contributions(spark, d)).select(
        "internal_company_id", num("total_contribution").alias("total_contribution"))


@query("attribution_by_group", accounted(f"""
SELECT CASE WHEN GROUPING(sector) = 0 THEN 'sector' WHEN GROUPING(segment) = 0 THEN 'segment' WHEN GROUPING(cohort) = 0 THEN 'cohort' ELSE 'total' END AS dimension,
  coalesce(sector, segment, cohort, 'all') AS member, {r('sum(c)')} AS total_contribution
FROM (SELECT *, year(date)::VARCHAR AS cohort FROM ctb) GROUP BY GROUPING SETS ((sector), (segment), (cohort), ())""", "bst ctb"))
def attribution_by_group(spark, d):
    c = _contributions(spark, d).withColumn("cohort", F.year("date").cast("string"))
    return P.contribution_by(c, ["sector", "segment", "cohort"]).select(
        "dimension", "member", num("total_contribution").alias("total_contribution"))


@query("dollar_volume_exposure", accounted(f"""
SELECT date::VARCHAR AS date, {r('sum(w * dv) / sum(CASE WHEN dv IS NOT NULL THEN w END)', 3)} AS weighted_avg_dollar_volume
FROM hold h LEFT JOIN (SELECT mkt, date, CASE WHEN count(px) OVER w >= 15 THEN avg(px * vol) OVER w END AS dv FROM px_nation
  WINDOW w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) USING (mkt, date)
WHERE date IN (SELECT date FROM px_nation) GROUP BY 1"""))
def dollar_volume_exposure(spark, d):
    held = V.portfolio(spark, d)["holdings"].join(V.entity_markets(spark, d), "internal_company_id")
    e = P.dollar_volume_exposure(held, V.prices(spark, d, "nation"), "market_id")
    return e.select(day("date").alias("date"), num("weighted_avg_dollar_volume", 3)
                    .alias("weighted_avg_dollar_volume"))


@query("cash_and_turnover", accounted(f"""
SELECT 'strategy' AS portfolio, {r('avg(cash)')} AS avg_cash_weight, {r('max(cash)')} AS max_cash_weight,
  {r('quantile_cont(cash, 0.95)')} AS p95_cash_weight, {r('avg(tov) * 252')} AS annualized_turnover,
  {r('avg(tov) * 252 * 2 * 0.001 * 100')} AS cost_drag_per_year_pct FROM daily"""))
def cash_and_turnover(spark, d):
    daily = V.portfolio(spark, d)["daily"].withColumn("portfolio", F.lit("strategy"))
    c = P.cash_and_turnover(daily, 10.0, ["portfolio"])
    return c.select("portfolio", *[num(x).alias(x) for x in c.columns[1:]])


@query("sensitivity_grid", accounted(f"""
SELECT 'cap_5pct' AS variant, bps::BIGINT AS cost_bps, {r('exp(sum(ln(1 + gross - cost * bps / 10)) * 252 / count(*)) - 1')} AS annualized_return,
  {r('stddev_samp(gross - cost * bps / 10) * sqrt(252)')} AS annualized_volatility
FROM daily, (VALUES (0), (5), (10), (25)) v(bps) GROUP BY 2"""))
def sensitivity_grid(spark, d):
    daily = V.portfolio(spark, d)["daily"]
    costs = F.explode(F.array(*[F.lit(b) for b in (0, 5, 10, 25)]))
    per = (daily.withColumn("cost_bps", costs)
           .withColumn("variant", F.lit("cap_5pct"))
           .withColumn("ret", F.col("gross_return")
                       - F.col("transaction_cost_return") * F.col("cost_bps") / 10.0))
    s = P.performance_summary(per, ["variant", "cost_bps"])
    return s.select("variant", big("cost_bps").alias("cost_bps"),
                    num("annualized_return").alias("annualized_return"),
                    num("annualized_volatility").alias("annualized_volatility"))


@query("construction_variants")
def construction_variants(spark, d):
    """Caps, thresholds, list lengths and execution delay, each through the whole accounting."""
    variants = {"cap_2pct": (replace(V.RULES, max_weight=0.02), 0),
                "signal_20pct": (replace(V.RULES, min_signal=0.2), 0),
                "top_20": (replace(V.RULES, max_positions=20), 0),
                "next_day": (V.RULES, 1)}
    rows = None
    for name, (rules, delay) in variants.items():
        picked = V.selected(spark, d, rules)
        daily = A.account(W.inverse_vol_weights(picked, rules), V.predictions(spark, d),
                          V.grid(spark, d), V.days(spark, d), key="market_id", delay=delay,
                          stage=materialize)["daily"]
        part = daily.select(F.lit(name).alias("variant"), "date", F.col("net_return").alias("ret"))
        rows = part if rows is None else rows.unionByName(part)
    s = P.performance_summary(rows, ["variant"])
    return s.select("variant", *[num(c).alias(c) for c in (
        "annualized_return", "annualized_volatility", "sharpe", "max_drawdown")])


def ema(x: str, keep: float, depth: int = 120) -> str:
    """Exponential smoothing from 1.0 over a frame long enough to be exact."""
    return (f"list_reduce(list_concat([1.0::DOUBLE], list({x}::DOUBLE) OVER (ORDER BY seq ROWS BETWEEN {depth} PRECEDING AND CURRENT ROW)), "
            f"lambda a, b: a * {keep} + b * (1 - {keep}))")


Q.fragment("ovl", """
SELECT d.*, i.ret AS mk, exp(sum(ln(1 + net)) OVER (ORDER BY seq)) AS eqv FROM daily d
LEFT JOIN (SELECT date, px / lag(px) OVER (ORDER BY date) - 1 AS ret FROM index_px WHERE sym = 'SPY') i USING (date)""")
Q.fragment("ovx", """
SELECT *, CASE WHEN seq > 20 THEN CASE WHEN v > 1e-6 THEN least(greatest(0.15 / (v * sqrt(252)), 0.2), 1.2) ELSE 1.2 END ELSE 1 END AS xv,
  CASE WHEN seq > 20 THEN CASE WHEN dd <= 0.1 THEN 1 ELSE greatest(0.3, 1 - (dd - 0.1) / 0.1) END ELSE 1 END AS xd,
  CASE WHEN seq > 20 THEN CASE WHEN dd <= tr THEN 1 ELSE greatest(0.3, 1 - (dd - tr) / tr) END ELSE 1 END AS xa,
  CASE WHEN seq > 20 THEN least(greatest(1 / greatest(1, be), 0.3), 1) ELSE 1 END AS xb FROM (
  SELECT *, stddev_samp(net) OVER p AS v, 1 - lag(eqv) OVER o / max(eqv) OVER q AS dd,
    CASE WHEN count(net) OVER p >= 10 AND stddev_samp(net) OVER p > 0
      THEN least(greatest(2 * stddev_samp(net) OVER p * sqrt(21), 0.05), 0.2) ELSE 0.1 END AS tr,
    CASE WHEN count(mk) OVER p >= 20 AND var_samp(mk) OVER p >= 1e-12 THEN regr_slope(net, mk) OVER p ELSE 1 END AS be
  FROM ovl WINDOW o AS (ORDER BY seq), p AS (ORDER BY seq ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING),
    q AS (ORDER BY seq ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))""")


@query("overlay_scales", accounted(f"""
SELECT date::VARCHAR AS date, {r(ema('xv', 0.7))} AS vol_scale, {r(ema('xd', 0.5))} AS drawdown_scale,
  {r(ema('xa', 0.5))} AS adaptive_drawdown_scale, {r(ema('xb', 0.5))} AS beta_scale FROM ovx""", "px_region index_px ovl ovx"))
def overlay_scales(spark, d):
    daily = V.portfolio(spark, d)["daily"]
    w = R.series("symbol", "date")
    market = (V.benchmarks(spark, d).where(F.col("symbol") == "SPY")
              .withColumn("market_ret", F.col("adjusted_close") / F.lag("adjusted_close").over(w) - 1.0))
    s = O.beta_scale(O.drawdown_scale(O.vol_scale(daily)), market)
    a = O.drawdown_scale(daily, adaptive=True).select("date", F.col("drawdown_scale").alias("ad"))
    s = s.join(a, "date")
    return s.select(day("date").alias("date"), num("vol_scale").alias("vol_scale"),
                    num("drawdown_scale").alias("drawdown_scale"),
                    num("ad").alias("adaptive_drawdown_scale"), num("beta_scale").alias("beta_scale"))


Q.fragment("scl", f"SELECT date, {ema('xv', 0.7)} * {ema('xd', 0.5)} * {ema('xb', 0.5)} AS x FROM ovx")
Q.fragment("tgt_o", """
SELECT t.date, t.ent, t.mkt, t.seq, t.w * x AS w, 1 - sum(t.w * x) OVER (PARTITION BY t.date) AS cash FROM tgt t JOIN scl USING (date)""")
for _name in ("dri", "trd", "gross", "daily"):  # the same accounting, on the scaled weights
    Q.fragment(f"{_name}_o", Q.renamed(_name, ("tgt", "dri", "trd", "gross"), "_o"))


@query("overlay_performance", accounted(f"""
, runs AS (SELECT 'none' AS overlay, date, net, cost, cash, tov FROM daily UNION ALL SELECT 'vol_drawdown_beta', date, net, cost, cash, tov FROM daily_o),
eq AS (SELECT *, exp(sum(ln(1 + net)) OVER (PARTITION BY overlay ORDER BY date)) AS e FROM runs),
dn AS (SELECT *, e / max(e) OVER (PARTITION BY overlay ORDER BY date) - 1 AS dd FROM eq),
s AS (SELECT overlay, exp(sum(ln(1 + net)) * 252 / count(*)) - 1 AS ar, stddev_samp(net) * sqrt(252) AS av, min(dd) AS mdd,
  sum(cost) AS cost, avg(cash) AS cash, min(cash) AS least_cash, avg(tov) * 252 AS tov FROM dn GROUP BY 1)
SELECT overlay, {r('ar')} AS annualized_return, {r('av')} AS annualized_volatility, {r('ar / av')} AS sharpe, {r('mdd')} AS max_drawdown,
  {r('cost')} AS total_cost, {r('cash')} AS avg_cash_weight, {r('least_cash')} AS least_cash_weight, {r('tov')} AS annualized_turnover FROM s""",
    "px_region index_px ovl ovx scl tgt_o dri_o trd_o gross_o daily_o"))
def overlay_performance(spark, d):
    """The strategy, and the same weights under volatility, drawdown and beta scales through accounting of their own."""
    daily = V.portfolio(spark, d)["daily"]
    w = R.series("symbol", "date")
    market = (V.benchmarks(spark, d).where(F.col("symbol") == "SPY")
              .withColumn("market_ret", F.col("adjusted_close") / F.lag("adjusted_close").over(w) - 1.0))
    scales = materialize(O.beta_scale(O.drawdown_scale(O.vol_scale(daily)), market), "scales")
    scaled = O.account_scaled(V.targets(spark, d), scales, ("vol_scale", "drawdown_scale", "beta_scale"), V.predictions(spark, d),
                              V.grid(spark, d), V.days(spark, d), key="market_id", stage=materialize)["daily"]
    rows = (daily.withColumn("overlay", F.lit("none"))
            .unionByName(scaled.withColumn("overlay", F.lit("vol_drawdown_beta"))))
    s = P.performance_summary(rows, ["overlay"], "net_return", "turnover")
    costs = rows.groupBy("overlay").agg(F.sum("transaction_cost_return").alias("total_cost"), F.avg("cash_weight").alias("avg_cash_weight"),
                                        F.min("cash_weight").alias("least_cash_weight"))
    return s.join(costs, "overlay").select("overlay", *[num(c).alias(c) for c in (
        "annualized_return", "annualized_volatility", "sharpe", "max_drawdown", "total_cost", "avg_cash_weight",
        "least_cash_weight", "annualized_turnover")])


@query("state_overlay_scales")
def state_overlay_scales(spark, d):
    """Vol-of-vol, loss-cluster, coherence and dispersion scales, and the scaled weights' cash."""
    daily = V.portfolio(spark, d)["daily"]
    s = O.cluster_scale(O.vol_of_vol_scale(daily))
    returns = mf.panel_returns(V.grid(spark, d), "market_id")
    s = (s.join(O.coherence_scale(mf.phase_coherence(returns, "market_id")), "date", "left")
         .join(O.dispersion_scale(mf.dispersion(returns)), "date", "left"))
    scaled = O.apply_scale(V.targets(spark, d), s, "dispersion_scale")
    cash = scaled.groupBy(F.col("as_of").alias("date")).agg(F.max("cash_weight").alias("cash"))
    s = s.join(cash, "date", "left")
    return s.select(day("date").alias("date"), num("vov_scale").alias("vov_scale"),
                    num("cluster_scale").alias("cluster_scale"),
                    num("coherence_scale").alias("coherence_scale"),
                    num("dispersion_scale").alias("dispersion_scale"),
                    num(F.coalesce("cash", F.lit(1.0))).alias("scaled_cash_weight"))


@query("robustness_rollup", accounted(f"""
, runs AS (SELECT p AS variant, CASE WHEN year(date) <= 1998 THEN 'early' ELSE 'late' END AS universe, date, ret FROM ball
  WHERE p IN ('strategy', 'inverse_vol_active', 'equal_weight_active')),
re AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY variant, universe ORDER BY date)) AS e FROM runs),
rs AS (SELECT *, e / max(e) OVER (PARTITION BY variant, universe ORDER BY date) - 1 AS dd FROM re),
rm AS (SELECT variant, universe, exp(sum(ln(1 + ret)) * 252 / count(*)) - 1 AS ar, stddev_samp(ret) * sqrt(252) AS av, min(dd) AS mdd FROM rs GROUP BY 1, 2),
rk AS (SELECT variant, universe, ar / av AS sharpe, mdd, ar / abs(mdd) AS calmar FROM rm)
SELECT a.variant, coalesce(a.universe, 'all') AS universe, {r('avg(a.sharpe)')} AS mean_sharpe, {r('avg(a.mdd)')} AS mean_max_drawdown,
  {r('avg((a.sharpe / b.sharpe - 1) * 100)', 4)} AS change_sharpe_pct, {r('avg((a.mdd / b.mdd - 1) * 100)', 4)} AS change_max_drawdown_pct, count(*)::BIGINT AS runs
FROM rk a JOIN rk b ON a.universe = b.universe AND b.variant = 'equal_weight_active' GROUP BY GROUPING SETS ((a.variant, a.universe), (a.variant))""", BENCH))
def robustness_rollup(spark, d):
    rows = (V.all_returns(spark, d)
            .where(F.col("portfolio").isin("strategy", "inverse_vol_active", "equal_weight_active"))
            .withColumn("variant", F.col("portfolio"))
            .withColumn("universe", F.when(F.year("date") <= 1998, "early").otherwise("late"))
            .withColumn("seed", F.lit(0)))
    s = P.performance_summary(rows, ["variant", "universe", "seed"])
    out = P.robustness_rollup(s, "equal_weight_active")
    return out.select("variant", F.coalesce("universe", F.lit("all")).alias("universe"),
                      num("mean_sharpe").alias("mean_sharpe"),
                      num("mean_max_drawdown").alias("mean_max_drawdown"),
                      num("change_sharpe_pct", 4).alias("change_sharpe_pct"),
                      num("change_max_drawdown_pct", 4).alias("change_max_drawdown_pct"),
                      big("runs").alias("runs"))
