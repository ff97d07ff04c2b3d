"""Calendar, event samples, universe filters, price features and targets."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.registry import ORACLES, big, day, num, query
from eventide.driver.sql import r
from eventide.operators import calendar as cal
from eventide.operators import events, price_features, scale_target, universe


@query("trading_calendar", Q.with_(Q.CAL, """
SELECT date::VARCHAR AS date, td AS is_trading_day, seq::BIGINT AS seq,
  coalesce(next_td::VARCHAR, '') AS next_td, coalesce(prev_td::VARCHAR, '') AS prev_td FROM cal"""))
def trading_calendar(spark, d):
    return V.calendar(spark, d).select(
        day("date").alias("date"), "is_trading_day", big("seq").alias("seq"),
        F.coalesce(day("next_td"), F.lit("")).alias("next_td"),
        F.coalesce(day("prev_td"), F.lit("")).alias("prev_td"))


@query("next_prev_trading_day", Q.with_(Q.CAL, """
SELECT o_orderkey, coalesce(a.next_td::VARCHAR, '') AS next_td, coalesce(a.prev_td::VARCHAR, '') AS prev_td,
  (b.seq - CASE WHEN a.td THEN a.seq ELSE a.seq + 1 END + 1)::BIGINT AS days_to_end
FROM orders JOIN cal a ON a.date = o_orderdate::DATE, bounds JOIN cal b ON b.date = bounds.hi"""))
def next_prev_trading_day(spark, d):
    c = V.calendar(spark, d)
    o = V.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").cast("date").alias("date"))
    o = o.withColumn("end", c.agg(F.max("date")).scalar())
    o = cal.with_neighbour(o, c, "date", "next_td", "next")
    o = cal.with_neighbour(o, c, "date", "prev_td", "previous")
    o = cal.with_trading_days_between(o, c, "date", "end", "n")
    return o.select("o_orderkey", F.coalesce(day("next_td"), F.lit("")).alias("next_td"),
                    F.coalesce(day("prev_td"), F.lit("")).alias("prev_td"),
                    big("n").alias("days_to_end"))


@query("event_samples", Q.with_(Q.samples() + " index_px", f"""
SELECT sid AS sample_id, ent AS internal_company_id, fid AS filing_event_id, ed::VARCHAR AS report_event_date,
  form AS form_type, en::VARCHAR AS entry_date, ex::VARCHAR AS exit_date, nfid AS next_filing_event_id,
  ned::VARCHAR AS next_report_event_date, {r('epx')} AS entry_price, {r('xpx')} AS exit_price,
  {r('ret')} AS raw_log_return, {r('sret')} AS raw_simple_return, split, hold::BIGINT AS holding_days,
  {r('ln(s1.px / s0.px)')} AS spy_log_return, {r('ln(q1.px / q0.px)')} AS qqq_log_return
FROM smp_region
LEFT JOIN index_px s0 ON s0.date = en AND s0.sym = 'SPY' LEFT JOIN index_px s1 ON s1.date = ex AND s1.sym = 'SPY'
LEFT JOIN index_px q0 ON q0.date = en AND q0.sym = 'QQQ' LEFT JOIN index_px q1 ON q1.date = ex AND q1.sym = 'QQQ'"""))
def event_samples(spark, d):
    return V.event_samples(spark, d).select(
        "sample_id", "internal_company_id", "filing_event_id",
        day("report_event_date").alias("report_event_date"), "form_type",
        day("entry_date").alias("entry_date"), day("exit_date").alias("exit_date"),
        "next_filing_event_id", day("next_report_event_date").alias("next_report_event_date"),
        num("entry_price").alias("entry_price"), num("exit_price").alias("exit_price"),
        num("raw_log_return").alias("raw_log_return"),
        num("raw_simple_return").alias("raw_simple_return"), "split",
        big("holding_days").alias("holding_days"), num("spy_log_return").alias("spy_log_return"),
        num("qqq_log_return").alias("qqq_log_return"))


@query("event_exclusions", Q.with_(Q.samples(), """
SELECT ent AS internal_company_id, fid AS filing_event_id, reason AS exclusion_reason
FROM staged_region WHERE reason IS NOT NULL
UNION ALL SELECT ent, fid, 'duplicate_event_same_date' FROM ranked_region WHERE rn > 1"""))
def event_exclusions(spark, d):
    return events.build_event_samples(
        V.placed_filings(spark, d), V.prices(spark, d), V.calendar(spark, d),
        train_end=V.TRAIN_END, validation_end=V.VALIDATION_END, price_key="market_id")[1]


_FORECAST = """
SELECT sid || '{suffix}' AS sample_id, ent AS internal_company_id, fid AS filing_event_id,
  ed::VARCHAR AS report_event_date, en::VARCHAR AS entry_date, x.date::VARCHAR AS exit_date,
  {px} AS entry_price, '{split}' AS split
FROM ({src}) e JOIN px_region p ON p.mkt = e.mkt AND p.date = e.en
JOIN cal c ON c.date = e.en
JOIN cal x ON x.td AND x.seq = least(c.seq + 60, (SELECT max(seq) FROM cal))"""
_SID = "'SAMPLE_' || substr(sha1(ent || '|' || fid), 1, 16) AS sid"


@query("open_live_samples", Q.with_(Q.samples(), _FORECAST.format(
    suffix="_OPEN", split="open", px=r("p.px"), src=f"""
  SELECT k.*, {_SID}, cal.next_td AS en FROM kept_region k JOIN cal ON cal.date = ed
  QUALIFY row_number() OVER (PARTITION BY ent ORDER BY ed DESC) = 1""")
    + " UNION ALL " + _FORECAST.format(suffix="_LIVE", split="live", px=r("p.px"), src=f"""
  SELECT k.*, {_SID}, (SELECT min(date) FROM cal WHERE td AND date >= DATE '2000-06-03') AS en
  FROM kept_region k WHERE ed <= (SELECT min(date) FROM cal WHERE td AND date >= DATE '2000-06-03')
  QUALIFY row_number() OVER (PARTITION BY ent ORDER BY ed DESC) = 1""")))
def open_live_samples(spark, d):
    args = (V.placed_filings(spark, d), V.prices(spark, d), V.calendar(spark, d))
    opened = events.build_open_samples(*args, price_key="market_id")
    live = events.build_live_samples(*args, price_key="market_id", as_of="2000-06-03")
    return opened.unionByName(live).select(
        "sample_id", "internal_company_id", "filing_event_id",
        day("report_event_date").alias("report_event_date"), day("entry_date").alias("entry_date"),
        day("exit_date").alias("exit_date"), num("entry_price").alias("entry_price"), "split")


@query("lagged_dollar_volume", Q.with_("px_nation", f"""
SELECT mkt AS market_id, date::VARCHAR AS date, {r('px * vol', 3)} AS dollar_volume,
  {r('CASE WHEN count(px) OVER w >= 126 THEN avg(px * vol) OVER w END', 3)} AS trailing_dv
FROM px_nation WINDOW w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"""))
def lagged_dollar_volume(spark, d):
    dv = universe.with_trailing_dollar_volume(V.prices(spark, d, "nation"), "market_id", 252, 126)
    return dv.select("market_id", day("date").alias("date"),
                     num("dollar_volume", 3).alias("dollar_volume"),
                     num("trailing_dv", 3).alias("trailing_dv"))


@query("pit_universe", Q.with_("co_nation px_nation fil_nation", f"""
SELECT p.mkt AS market_id, '2000-06-30' AS as_of, {r('last_close')} AS last_close, {r('dv', 3)} AS trailing_dv,
  n::BIGINT AS rows, e.n2::BIGINT AS events FROM (
  SELECT mkt, max(date) AS ld, count(*) AS n, arg_max(px, date) AS last_close, last(dv ORDER BY date) AS dv FROM (
    SELECT *, CASE WHEN count(px) OVER w >= 126 THEN avg(px * vol) OVER w END AS dv FROM px_nation
    WHERE date <= DATE '2000-06-30'
    WINDOW w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) GROUP BY 1) p
JOIN (SELECT mkt, count(*) AS n2 FROM fil_nation WHERE ed < DATE '2000-06-30' GROUP BY 1) e ON e.mkt = p.mkt
WHERE ld >= DATE '2000-06-20' AND last_close >= 5 AND n >= 1008 AND dv >= 60000 AND n2 >= 12"""))
def pit_universe(spark, d):
    rules = universe.UniverseRules(min_years=4, min_dollar_volume=60_000.0)
    out = universe.point_in_time_universe(V.prices(spark, d, "nation"),
                                          V.placed_filings(spark, d, "nation"), "2000-06-30",
                                          "market_id", rules)
    return out.select("market_id", day("as_of").alias("as_of"), num("last_close").alias("last_close"),
                      num("trailing_dv", 3).alias("trailing_dv"), big("rows").alias("rows"),
                      big("events").alias("events"))


@query("sample_liquidity_filter", Q.with_(Q.samples(), """
SELECT sid AS sample_id, CASE WHEN coalesce(rows, 0) < 504 THEN 'filter_insufficient_history'
  WHEN cl < 1500 THEN 'filter_below_min_price'
  WHEN dv IS NULL OR dv < 150000 THEN 'filter_below_min_adv' ELSE 'kept' END AS verdict
FROM smp_region s ASOF LEFT JOIN (
  SELECT mkt, date, row_number() OVER o AS rows, coalesce(lag(px) OVER o, px) AS cl,
    CASE WHEN count(px) OVER w >= 63 THEN avg(px * vol) OVER w END AS dv FROM px_region
  WINDOW o AS (PARTITION BY mkt ORDER BY date),
    w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)) p
ON s.mkt = p.mkt AND s.en > p.date"""))
def sample_liquidity_filter(spark, d):
    rules = universe.UniverseRules(min_price=1500.0, min_dollar_volume=150_000.0, min_years=2)
    kept, dropped = universe.apply_sample_filter(V.event_samples(spark, d), V.prices(spark, d),
                                                 "market_id", rules)
    return (kept.select("sample_id", F.lit("kept").alias("verdict"))
            .unionByName(dropped.withColumnRenamed("exclusion_reason", "verdict")))


@query("ex_ante_scale", Q.with_(Q.scaled(), f"""
SELECT sid AS sample_id, {r('dvol')} AS daily_vol, {r('evol')} AS event_vol, {r('scale')} AS ex_ante_scale,
  {r('ret / scale')} AS standardized_movement, coalesce(abs(ret) > 3 * scale, false) AS is_extreme_target_event
FROM scl_region"""))
def ex_ante_scale(spark, d):
    out = scale_target.with_ex_ante_scale(V.event_samples(spark, d), V.prices(spark, d), "market_id")
    return out.select("sample_id", num("daily_vol").alias("daily_vol"),
                      num("event_vol").alias("event_vol"), num("ex_ante_scale").alias("ex_ante_scale"),
                      num("standardized_movement").alias("standardized_movement"),
                      "is_extreme_target_event")


def _target(spark, d, mode, **kw):
    out = scale_target.with_target(V.scaled_samples(spark, d).drop("exclusion_reason"), mode, **kw)
    return out.select("sample_id", num("target_normalized_signal").alias("target"),
                      "eligible_for_training",
                      F.coalesce("exclusion_reason", F.lit("")).alias("exclusion_reason"))


_TARGET = """
SELECT sid AS sample_id, {expr} AS target, scale IS NOT NULL AS eligible_for_training,
  CASE WHEN scale IS NULL THEN 'missing_ex_ante_scale' ELSE '' END AS exclusion_reason FROM scl_region"""


def avg_pct(value: str, part: str) -> str:
    """Average-tie percent rank of ``value`` among its non-null peers."""
    return (f"((rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1)"
            f" / 2.0) / count({value}) OVER (PARTITION BY {part}))")


@query("tanh_target", Q.with_(Q.scaled(), _TARGET.format(expr=r("tanh(ret / (2.5 * scale))"))))
def tanh_target(spark, d):
    return _target(spark, d, "tanh_scaled")


_RANKED = "(SELECT *, {pct} AS pct FROM (SELECT *, CASE WHEN scale IS NOT NULL THEN ret END AS vr FROM scl_region))"


@query("rank_target", Q.with_(Q.scaled(), _TARGET.format(
    expr=r("CASE WHEN vr IS NOT NULL THEN 2 * pct - 1 END")).replace(
        "FROM scl_region", "FROM " + _RANKED.format(pct=avg_pct("vr", "date_trunc('quarter', en)")))))
def rank_target(spark, d):
    return _target(spark, d, "cross_sectional_rank")


@query("sector_rank_target", Q.with_(Q.scaled(), _TARGET.format(
    expr=r("CASE WHEN vr IS NOT NULL THEN 2 * pct - 1 END")).replace(
        "FROM scl_region",
        "FROM " + _RANKED.format(pct=avg_pct("vr", "date_trunc('quarter', en), segment")))))
def sector_rank_target(spark, d):
    return _target(spark, d, "sector_neutral_rank", sector="segment")


@query("sample_weights", Q.with_(Q.samples(), f"""
SELECT sid AS sample_id, {r('w / avg(w) OVER ()')} AS sample_weight FROM (
  SELECT sid, 1.0 / count(*) OVER (PARTITION BY ent) / count(*) OVER (PARTITION BY date_trunc('quarter', en)) AS w
  FROM smp_region)"""))
def sample_weights(spark, d):
    return scale_target.frequency_weights(V.event_samples(spark, d)).select(
        "sample_id", num("sample_weight").alias("sample_weight"))


@query("rank_labels", Q.with_(Q.samples(), f"""
SELECT sid AS sample_id, q AS quarter, least(floor(pct * 30.999), 30)::BIGINT AS relevance,
  count(*) OVER (PARTITION BY q)::BIGINT AS group_size FROM (
  SELECT *, {avg_pct('ret', 'q')} AS pct FROM (
    SELECT *, year(en)::VARCHAR || 'Q' || quarter(en)::VARCHAR AS q FROM smp_region))"""))
def rank_labels(spark, d):
    labelled = scale_target.rank_labels(V.event_samples(spark, d))
    return (labelled.join(scale_target.group_sizes(labelled), "quarter")
            .select("sample_id", "quarter", big("relevance").alias("relevance"),
                    big("group_size").alias("group_size")))


@query("holdout_split", Q.with_(Q.samples(), """
SELECT sid AS sample_id, split, (('0x' || substr(sha1(ent), 1, 8))::BIGINT % 10) IN (7, 8, 9) AS held_out
FROM smp_region"""))
def holdout_split(spark, d):
    return universe.company_holdout(V.event_samples(spark, d), "internal_company_id",
                                    [7, 8, 9]).select("sample_id", "split", "held_out")


_PF = price_features.feature_ids(6)


@query("asof_price_features", Q.with_(Q.samples(), f"""
SELECT sid AS sample_id, {', '.join(f"{r(f'f{i}')} AS {n}" for i, n in enumerate(_PF))}
FROM smp_region s ASOF LEFT JOIN (
  SELECT mkt, date, l - lag(l, 21) OVER w AS f0, l - lag(l, 63) OVER w AS f1, l - lag(l, 126) OVER w AS f2,
    l - lag(l, 252) OVER w AS f3, lag(l, 63) OVER w - lag(l, 21) OVER w AS f4,
    CASE WHEN n > 63 THEN stddev_samp(lr) OVER v END AS f5
  FROM (SELECT mkt, date, ln(px) AS l, ln(px) - lag(ln(px)) OVER o AS lr, row_number() OVER o AS n FROM px_region
        WINDOW o AS (PARTITION BY mkt ORDER BY date))
  WINDOW w AS (PARTITION BY mkt ORDER BY date),
    v AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) p
ON s.mkt = p.mkt AND s.en > p.date"""))
def asof_price_features(spark, d):
    out, ids = price_features.with_price_features(V.event_samples(spark, d), V.prices(spark, d),
                                                  "market_id")
    return out.select("sample_id", *[num(i).alias(i) for i in ids])


_STATS = ", ".join(
    f"quantile_cont(CASE WHEN split = 'train' THEN f{i} END, 0.5) OVER () AS m{i}, "
    f"quantile_cont(CASE WHEN split = 'train' THEN f{i} END, 0.75) OVER () - "
    f"quantile_cont(CASE WHEN split = 'train' THEN f{i} END, 0.25) OVER () AS q{i}" for i in range(6))


@query("scaled_price_features", ORACLES["asof_price_features"].split("SELECT sid AS sample_id")[0] + f"""
SELECT sid AS sample_id, {', '.join(f"{r(f'CASE WHEN f{i} IS NULL THEN 0 ELSE least(greatest((f{i} - m{i}) / q{i}, -10), 10) END')} AS {n}, (f{i} IS NULL)::BIGINT AS {n}_missing" for i, n in enumerate(_PF))}
FROM (SELECT sid, split, f0, f1, f2, f3, f4, f5, {_STATS} FROM smp_region s ASOF LEFT JOIN (
""" + ORACLES["asof_price_features"].split("ASOF LEFT JOIN (", 1)[1] + ")")
def scaled_price_features(spark, d):
    out, ids = price_features.with_price_features(V.event_samples(spark, d), V.prices(spark, d),
                                                  "market_id")
    stats = price_features.fit_scaler(out.where(F.col("split") == "train"), ids)
    scaled = price_features.scale_features(out, ids, stats)
    return scaled.select("sample_id", *[num(i).alias(i) for i in ids],
                         *[big(f"{i}_missing").alias(f"{i}_missing") for i in ids])
