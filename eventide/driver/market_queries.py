"""Market-state panel, per-entity features and event cadence."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.registry import big, day, num, query
from eventide.driver.sql import r
from eventide.functions import rolling as R
from eventide.operators import entity_features as ef
from eventide.operators import market_features as mf

Q.fragment("tds", "SELECT date, (row_number() OVER (ORDER BY date) - 1)::BIGINT AS seq FROM cal WHERE td")
Q.fragment("grid", """
SELECT m.mkt, t.date, t.seq, p.px, p.vol FROM (SELECT DISTINCT mkt FROM px_nation) m CROSS JOIN tds t
ASOF LEFT JOIN (SELECT px_nation.* FROM px_nation JOIN tds USING (date)) p ON p.mkt = m.mkt AND t.date >= p.date""")
Q.fragment("gret", """
SELECT *, ln(px / lag(px) OVER (PARTITION BY mkt ORDER BY seq)) AS r FROM grid""")
Q.fragment("gday", """
SELECT date, seq, stddev_samp(r) AS temperature, avg(r) AS mean_ret, avg(abs(r)) AS mean_abs_ret
FROM gret GROUP BY 1, 2""")
GRID = f"{Q.CAL} px_nation tds grid gret gday"


def z(x: str, n: int, m: int) -> str:
    w = f"OVER (ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return (f"(CASE WHEN count({x}) {w} >= {m} THEN ({x} - avg({x}) {w}) / "
            f"nullif(stddev_samp({x}) {w}, 0) END)")


def sd(x: str, n: int, m: int, part: str = "") -> str:
    w = f"OVER ({part} ORDER BY seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {w} >= {m} THEN stddev_samp({x}) {w} END)"


@query("filled_price_grid", Q.with_(GRID, f"""
SELECT mkt AS market_id, date::VARCHAR AS date, seq, {r('px')} AS adjusted_close FROM grid"""))
def filled_price_grid(spark, d):
    return V.grid(spark, d).select("market_id", day("date").alias("date"), big("seq").alias("seq"),
                                   num("adjusted_close").alias("adjusted_close"))


@query("market_dispersion", Q.with_(GRID, f"""
SELECT date::VARCHAR AS date, {r('temperature')} AS temperature, {r('mean_ret')} AS mean_ret,
  {r(z('temperature', 252, 20))} AS temperature_z, {r('vov')} AS vol_of_vol FROM (
  SELECT *, {sd('s', 60, 10)} AS vov FROM (SELECT *, {sd('mean_abs_ret', 20, 10)} AS s FROM gday))"""))
def market_dispersion(spark, d):
    daily = mf.dispersion(mf.panel_returns(V.grid(spark, d), "market_id"))
    w = mf._daily()
    out = (daily.withColumn("tz", R.rolling_z("temperature", w, 252, 20))
           .withColumn("_s", R.rolling_std("mean_abs_ret", w, 20, 10))
           .withColumn("vov", R.rolling_std("_s", w, 60, 10)))
    return out.select(day("date").alias("date"), num("temperature").alias("temperature"),
                      num("mean_ret").alias("mean_ret"), num("tz").alias("temperature_z"),
                      num("vov").alias("vol_of_vol"))


@query("phase_coherence", Q.with_(GRID, f"""
SELECT date::VARCHAR AS date, CASE WHEN count(*) >= 10 AND count(s) = count(*)
  THEN {r('sqrt(avg(cos(ph)) ** 2 + avg(sin(ph)) ** 2)')} END AS coherence
FROM (SELECT *, pi() * least(greatest(r / CASE WHEN s > 1e-9 THEN s WHEN s IS NOT NULL THEN 1 END, -1), 1) AS ph
  FROM (SELECT *, {sd('r', 60, 20, 'PARTITION BY mkt')} AS s FROM gret) WHERE r IS NOT NULL) GROUP BY 1"""))
def phase_coherence(spark, d):
    out = mf.phase_coherence(mf.panel_returns(V.grid(spark, d), "market_id"), "market_id")
    return out.select(day("date").alias("date"), num("coherence").alias("coherence"))


@query("event_cluster_z", Q.with_(GRID, f"""
SELECT date::VARCHAR AS date, {r('CASE WHEN sp > 1e-12 THEN (cur - mu) / sp END')} AS cluster_z FROM (
  SELECT date, max(c) FILTER (WHERE k = 0) AS cur, avg(c) FILTER (WHERE k > 0) AS mu,
    stddev_samp(c) FILTER (WHERE k > 0) AS sp FROM (
    SELECT i.date, i.seq, k, count(*) FILTER (WHERE j.mean_ret < -i.sg) AS c
    FROM (SELECT *, {sd('mean_ret', 60, 10)} AS sg FROM gday) i, range(253) t(k), gday j
    WHERE i.seq >= 371 AND i.sg > 0 AND j.seq BETWEEN i.seq - k - 59 AND i.seq - k GROUP BY 1, 2, 3) GROUP BY 1)"""))
def event_cluster_z(spark, d):
    daily = mf.dispersion(mf.panel_returns(V.grid(spark, d), "market_id"))
    return mf.event_cluster_z(daily).select(day("date").alias("date"),
                                            num("cluster_z").alias("cluster_z"))


@query("market_mode_share")
def market_mode_share(spark, d):
    out = mf.market_mode_share(mf.panel_returns(V.grid(spark, d), "market_id"), "market_id")
    return out.select(day("date").alias("date"), num("mode_share").alias("mode_share"))


@query("market_features_on_samples")
def market_features_on_samples(spark, d):
    panel = mf.market_panel(V.grid(spark, d), "market_id")
    out = mf.attach_to_samples(V.event_samples(spark, d), panel)
    return out.select("sample_id", *[num(c).alias(c) for f in mf.FEATURE_IDS
                                     for c in (f, f"{f}_missing")])


Q.fragment("hp", """
SELECT *, row_number() OVER (PARTITION BY mkt ORDER BY date) AS n FROM px_region""")
Q.fragment("probe", """
SELECT DISTINCT s.mkt, s.en, p.n FROM smp_region s ASOF JOIN hp p ON p.mkt = s.mkt AND s.en > p.date WHERE p.n >= 50""")
Q.fragment("hr", """
SELECT b.mkt, b.en, row_number() OVER w - 2 AS pos, ln(h.px / lag(h.px) OVER w) AS r
FROM probe b JOIN hp h ON h.mkt = b.mkt AND h.n BETWEEN b.n - 252 AND b.n
WINDOW w AS (PARTITION BY b.mkt, b.en ORDER BY h.n)""")
Q.fragment("hs", """
SELECT *, count(*) OVER p AS n, avg(r) OVER p AS mu, stddev_samp(r) OVER p AS sg FROM hr WHERE pos >= 0
WINDOW p AS (PARTITION BY mkt, en)""")
ENT = Q.samples() + " hp probe hr hs"


@query("entity_moments", Q.with_(ENT, f"""
SELECT sid AS sample_id, {r('coalesce(sk, 0)')} AS skewness, {r('coalesce(ku, 0)')} AS kurtosis,
  {r('CASE WHEN n >= 50 THEN lz ELSE 0 END')} AS levy_z, {r('CASE WHEN n >= 50 THEN coalesce(ly, 0) ELSE 0 END')} AS lyapunov, (n IS NULL)::BIGINT AS missing
FROM smp_region s LEFT JOIN (SELECT mkt, en, max(n) AS n, avg((r - mu) ** 3) / avg((r - mu) ** 2) ** 1.5 AS sk,
  avg((r - mu) ** 4) / avg((r - mu) ** 2) ** 2 - 3 AS ku,
  (avg((abs(r) > 3 * sg)::INT) - 0.0027) / sqrt(0.0027 * 0.9973 / max(n)) AS lz,
  CASE WHEN count(*) FILTER (WHERE abs(r) > 1e-9) >= 10 THEN avg(ln(abs(r))) FILTER (WHERE abs(r) > 1e-9) END AS ly
  FROM hs GROUP BY 1, 2) h ON h.mkt = s.mkt AND h.en = s.en"""))
def entity_moments(spark, d):
    out = ef.with_entity_features(V.event_samples(spark, d), V.prices(spark, d), "market_id")
    return out.select("sample_id", num("f_stock_skew").alias("skewness"),
                      num("f_stock_kurtosis").alias("kurtosis"),
                      num("f_stock_levy_z").alias("levy_z"),
                      num("f_stock_lyapunov").alias("lyapunov"),
                      big("f_stock_skew_missing").alias("missing"))


@query("hurst_dfa", Q.with_(ENT, f"""
SELECT sid AS sample_id, {r('CASE WHEN h.mkt IS NULL THEN 0 WHEN hu IS NULL THEN 0.5 ELSE least(greatest(hu, 0), 1) END')} AS hurst,
  {r('CASE WHEN h.mkt IS NULL THEN 0 WHEN al IS NULL THEN 0.5 ELSE least(greatest(al, 0), 1.5) END')} AS dfa
FROM smp_region s LEFT JOIN (SELECT DISTINCT mkt, en FROM hs) h ON h.mkt = s.mkt AND h.en = s.en
LEFT JOIN (SELECT mkt, en, regr_slope(ln(rs), ln(l)) AS hu FROM (
  SELECT mkt, en, l, avg((mx - mn) / sd) AS rs FROM (
    SELECT mkt, en, l, b, max(c) AS mx, min(c) AS mn, max(sd) AS sd FROM (
      SELECT *, sum(r - bm) OVER (PARTITION BY mkt, en, l, b ORDER BY pos) AS c FROM (
        SELECT mkt, en, l, pos // l AS b, pos, r, avg(r) OVER v AS bm, stddev_samp(r) OVER v AS sd
        FROM hs, (VALUES (10), (20), (50), (100), (200)) t(l)
        WHERE n >= 50 AND (l < 100 OR n >= 200) AND l < n AND (pos // l) * l < n - l
        WINDOW v AS (PARTITION BY mkt, en, l, pos // l))) GROUP BY 1, 2, 3, 4)
    WHERE sd > 1e-12 AND mx > mn GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2) u ON u.mkt = s.mkt AND u.en = s.en
LEFT JOIN (SELECT mkt, en, regr_slope(ln(greatest(f, 1e-12)), ln(l)) AS al FROM (
  SELECT mkt, en, l, avg(sqrt(greatest(syy - sxy * sxy / sxx, 0) / l)) AS f FROM (
    SELECT mkt, en, l, b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM (
      SELECT mkt, en, l, pos // l AS b, (pos % l)::DOUBLE AS x, y FROM (
        SELECT *, sum(r - mu) OVER (PARTITION BY mkt, en ORDER BY pos) AS y FROM hs WHERE n >= 64) q,
        (VALUES (8), (16), (32), (64), (128)) t(l)
      WHERE (l < 128 OR n >= 128) AND l < n AND n // l >= 2 AND pos // l < n // l) GROUP BY 1, 2, 3, 4)
  GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) >= 2) a ON a.mkt = s.mkt AND a.en = s.en"""))
def hurst_dfa(spark, d):
    out = ef.with_entity_features(V.event_samples(spark, d), V.prices(spark, d), "market_id")
    return out.select("sample_id", num("f_stock_hurst").alias("hurst"),
                      num("f_stock_dfa_alpha").alias("dfa"))


@query("filing_cadence", Q.with_("co_region fil_region", """
SELECT ent AS internal_company_id, max(ed)::VARCHAR AS last_event_date,
  coalesce(trunc(median(gap)), 91)::BIGINT AS cadence_days,
  (max(ed) + coalesce(trunc(median(gap)), 91)::INTEGER)::VARCHAR AS next_event_estimate FROM (
  SELECT ent, ed, ed - lag(ed) OVER (PARTITION BY ent ORDER BY ed) AS gap FROM fil_region) GROUP BY 1"""))
def filing_cadence(spark, d):
    return ef.filing_cadence(V.filings(spark, d)).select(
        "internal_company_id", day("last_event_date").alias("last_event_date"),
        big("cadence_days").alias("cadence_days"),
        day("next_event_estimate").alias("next_event_estimate"))
