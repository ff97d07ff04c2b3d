"""Candidate selection and every weighting rule, for all trading days."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.registry import big, day, num, query
from eventide.driver.sql import r
from eventide.operators import candidates as C
from eventide.operators import denoise
from eventide.operators import weights as W

Q.fragment("tds", "SELECT date, (row_number() OVER (ORDER BY date) - 1)::BIGINT AS seq FROM cal WHERE td")
Q.fragment("pred", """
SELECT *, 0.5 + sig / 4 AS prob, 0.1 + abs(sig) / 5 AS std FROM (
  SELECT *, tanh(amount / (SELECT avg(amount) FROM scl_nation) - 1) AS sig FROM scl_nation)""")
Q.fragment("rvol", """
SELECT mkt, date, CASE WHEN v > 0 THEN least(greatest(v, 0.005), 0.10) END AS vol FROM (
  SELECT mkt, date, CASE WHEN count(lr) OVER w >= 63 THEN stddev_samp(lr) OVER w END AS v FROM dr_nation
  WINDOW w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW))""")
Q.fragment("live", """
SELECT t.date, t.seq, p.* EXCLUDE (vol, rn) FROM (SELECT *, 0 AS vol FROM pred) p
JOIN tds t ON t.date BETWEEN p.en AND p.ex
QUALIFY row_number() OVER (PARTITION BY t.date, ent ORDER BY en DESC, sid DESC) = 1""")
Q.fragment("act", """
SELECT l.*, v.vol FROM live l ASOF JOIN rvol v ON v.mkt = l.mkt AND l.date > v.date WHERE v.vol IS NOT NULL""")
Q.fragment("pick", """
SELECT * FROM (SELECT *, greatest(sig, 0) AS s, row_number() OVER (PARTITION BY date ORDER BY greatest(sig, 0) DESC, ent) AS rk
  FROM act WHERE greatest(sig, 0) >= 0.05) WHERE rk <= 100""")
ACT = Q.scaled("nation") + " tds pred rvol live act"
PICK = ACT + " pick"


def capped(src: str, cap: str, part: str = "date", name: str = "ent") -> str:
    """Water-filled weights of a (date, name, w, ...) relation."""
    return f"""(SELECT * EXCLUDE (w, lvl), CASE WHEN lvl IS NULL THEN CASE WHEN w > 0 THEN {cap} ELSE 0 END
  ELSE least({cap}, w * lvl) END AS w FROM (
  SELECT * EXCLUDE (f, k), arg_min(f, k) FILTER (WHERE w * f <= {cap} + 1e-12) OVER (PARTITION BY {part}) AS lvl FROM (
    SELECT *, CASE WHEN tot - ahead > 1e-15 THEN (tot - k * {cap}) / (tot - ahead) END AS f FROM (
      SELECT *, sum(w) OVER (PARTITION BY {part}) AS tot,
        row_number() OVER o - 1 AS k,
        coalesce(sum(w) OVER (PARTITION BY {part} ORDER BY w DESC, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM {src} WINDOW o AS (PARTITION BY {part} ORDER BY w DESC, {name})) ) ) )""".replace(
          "EXCLUDE (f, k)", "EXCLUDE (f, k, tot, ahead)")


def floored(raw: str, src: str, extra: str = "") -> str:
    """Normalised weights with the small ones dropped."""
    extra = f", {extra}" if extra else ""
    share = "CASE WHEN sum(raw) OVER p > 0 THEN raw / sum(raw) OVER p ELSE 1.0 / count(*) OVER p END"
    return f"""(SELECT * EXCLUDE (w0), w0 / sum(w0) OVER (PARTITION BY date) AS w FROM (
  SELECT * EXCLUDE (w1, raw), CASE WHEN w1 < 0.0025 THEN 0 ELSE w1 END AS w0 FROM (
    SELECT *, {share} AS w1 FROM (SELECT date, ent{extra}, {raw} AS raw FROM {src})
    WINDOW p AS (PARTITION BY date))))"""


def final(w: str) -> str:
    return f"""SELECT date::VARCHAR AS as_of, ent AS internal_company_id, {r('w')} AS weight,
  {r('greatest(0, 1 - sum(w) OVER (PARTITION BY date))')} AS cash_weight FROM {w} WHERE w > 0"""


def out(df):
    return df.select(day("as_of").alias("as_of"), "internal_company_id",
                     num("weight").alias("weight"), num("cash_weight").alias("cash_weight"))


Q.fragment("target", f"SELECT date, ent, w FROM {capped(floored('s / vol', 'pick'), '0.05')} WHERE w > 0")


@query("portfolio_candidates", Q.with_(PICK, f"""
SELECT date::VARCHAR AS as_of, ent AS internal_company_id, sid AS sample_id, rk::BIGINT AS signal_rank,
  {r('s')} AS positive_signal, {r('vol')} AS vol_estimate,
  {r('CASE WHEN scale > 0 THEN atanh(least(greatest(sig, -0.99), 0.99)) * 2.5 * scale END')} AS restored_return
FROM pick"""))
def portfolio_candidates(spark, d):
    from eventide.functions.scalars import restore_signal
    return V.picks(spark, d).select(
        day("as_of").alias("as_of"), "internal_company_id", "sample_id",
        big("signal_rank").alias("signal_rank"), num("positive_signal").alias("positive_signal"),
        num("vol_estimate").alias("vol_estimate"),
        num(restore_signal("predicted_signal", "ex_ante_scale")).alias("restored_return"))


@query("inverse_vol_weights", Q.with_(PICK, final(capped(floored("s / vol", "pick"), "0.05"))))
def inverse_vol_weights(spark, d):
    return out(W.inverse_vol_weights(V.picks(spark, d), V.RULES))


@query("capped_weights", Q.with_(PICK, final(capped(floored("s ** 2 / vol", "pick"), "0.02"))))
def capped_weights(spark, d):
    rules = replace(V.RULES, max_weight=0.02, signal_power=2.0)
    return out(W.inverse_vol_weights(V.picks(spark, d), rules))


@query("sector_capped_weights", Q.with_(PICK, f"""
, base AS (SELECT * FROM {capped(floored('s / vol', 'pick', 'sector'), '0.05')}),
tot AS (SELECT date, sum(w) AS t FROM base GROUP BY 1),
sec AS (SELECT b.date, sector, sum(w) / any_value(t) AS w FROM base b JOIN tot USING (date) GROUP BY 1, 2),
fac AS (SELECT date, sector, w AS share FROM {capped('sec', '0.25', name='sector')}),
scaled_w AS (SELECT b.date, ent, b.w * share * t / sum(b.w) OVER (PARTITION BY b.date, sector) AS w
  FROM base b JOIN fac USING (date, sector) JOIN tot USING (date))
""".replace("\n, base", ", base", 1) + final(capped("scaled_w", "0.05"))))
def sector_capped_weights(spark, d):
    rules = replace(V.RULES, max_sector_weight=0.25)
    return out(W.inverse_vol_weights(V.picks(spark, d), rules))


@query("distribution_weights", Q.with_(ACT, f"""
, dist AS (SELECT * FROM (SELECT *, prob - 0.5 AS conf, greatest(std, 0.05) AS fs,
  row_number() OVER (PARTITION BY date ORDER BY greatest(prob - 0.5, 0) / greatest(std, 0.05) DESC, ent) AS rk
  FROM act WHERE prob >= 0.55) WHERE rk <= 100)
""".replace("\n, dist", ", dist", 1) + final(capped(floored("conf / fs / vol", "dist"), "0.05"))))
def distribution_weights(spark, d):
    picked = C.distribution_candidates_by_day(V.pieces(spark, d), V.risk_vol(spark, d), "market_id", V.days(spark, d), V.RULES)
    return out(W.distribution_weights(picked, V.RULES))


@query("blended_weights", Q.with_(PICK, f"""
, nn AS (SELECT date, count(*) AS n FROM act GROUP BY 1),
big AS (SELECT date, ent, sector, greatest(1 + 0.5 * (prob - 0.5), 0) / vol / sum(greatest(1 + 0.5 * (prob - 0.5), 0) / vol)
  OVER (PARTITION BY date) AS w FROM act JOIN nn USING (date) WHERE n >= 50),
smallp AS (SELECT * FROM pick WHERE date IN (SELECT date FROM nn WHERE n < 50)),
allw AS (SELECT date, ent, w FROM {capped('big', '0.05')} UNION ALL
  SELECT date, ent, w FROM {capped(floored('s / vol', 'smallp'), '0.05')})
""".replace("\n, nn", ", nn", 1) + final("allw")))
def blended_weights(spark, d):
    return out(W.blended_weights(V.active(spark, d), V.RULES))


_BAR = "0.8 / count(*) OVER (PARTITION BY date) + CASE WHEN rk <= 5 THEN 0.2 / least(count(*) OVER (PARTITION BY date), 5) ELSE 0 END"


@query("barbell_weights", Q.with_(PICK, final(capped(floored(_BAR, "pick"), "0.05"))))
def barbell_weights(spark, d):
    return out(W.barbell_weights(V.picks(spark, d), V.RULES))


@query("tail_aware_weights", Q.with_(PICK, f"""
, es0 AS (SELECT mkt, date, list(lr) OVER (PARTITION BY mkt ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS l
  FROM dr_nation),
es1 AS (SELECT mkt, date, list_sort(list_filter(l, lambda x: x IS NOT NULL)) AS l FROM es0),
es AS (SELECT mkt, date, CASE WHEN len(l) >= 40 THEN -list_avg(l[1:greatest(1, floor(len(l) * 0.05))::BIGINT]) END AS es FROM es1),
tp AS (SELECT p.*, e.es, bool_or(e.es IS NULL) OVER (PARTITION BY p.date) AS unk
  FROM pick p ASOF LEFT JOIN es e ON e.mkt = p.mkt AND p.date > e.date)
""".replace("\n, es0", ", es0", 1) + final(capped(floored(
    "CASE WHEN unk THEN s / vol ELSE s / greatest(es, 1e-9) END", "tp"), "0.05"))))
def tail_aware_weights(spark, d):
    risk = W.tail_risk_by_day(V.prices(spark, d, "nation"), V.calendar(spark, d), V.days(spark, d),
                              "market_id")
    return out(W.tail_aware_weights(V.picks(spark, d), risk, "market_id", V.RULES))


@query("signal_transforms", Q.with_(PICK, f"""
SELECT date::VARCHAR AS as_of, ent AS internal_company_id, {r('s / (greatest(km, 1e-9) + s)')} AS saturated,
  {r('CASE WHEN n >= 3 AND va * (n - 1) > 1e-12 THEN mu + (1 - least(1, greatest(0, (n - 2) * va / n / (va * (n - 1))))) * (s - mu) ELSE s END')} AS shrunk,
  {r('CASE WHEN n >= 3 AND va * (n - 1) > 1e-12 THEN mu + (1 - least(1, greatest(0, (n - 2) * 0.01 / (va * (n - 1))))) * (s - mu) ELSE s END')} AS shrunk_noise,
  {r('sig * least(greatest(exp(-least(greatest(date - en, 0), 252) / 63.0), 0.1), 1)')} AS decayed,
  {r('sig * least(greatest(1 - least(greatest(date - en, 0), 252) / 63.0 * 0.9, 0.1), 1)')} AS decayed_linear
FROM (SELECT *, median(s) OVER p AS km, count(*) OVER p AS n, avg(s) OVER p AS mu, var_samp(s) OVER p AS va
  FROM pick WINDOW p AS (PARTITION BY date))"""))
def signal_transforms(spark, d):
    p = V.picks(spark, d)
    p = W.saturated(p, "positive_signal", "sat")
    p = W.shrunk(p, "positive_signal", "shr")
    p = W.shrunk(p, "positive_signal", "shr2", noise_var=0.01)
    p = C.with_decayed_signal(p.withColumn("_keep", F.col("predicted_signal")))
    p = p.withColumnRenamed("predicted_signal", "dec").withColumnRenamed("_keep", "predicted_signal")
    p = C.with_decayed_signal(p, mode="linear")
    return p.select(day("as_of").alias("as_of"), "internal_company_id", num("sat").alias("saturated"),
                    num("shr").alias("shrunk"), num("shr2").alias("shrunk_noise"),
                    num("dec").alias("decayed"), num("predicted_signal").alias("decayed_linear"))


@query("signal_entropy", Q.with_(PICK, f"""
SELECT date::VARCHAR AS as_of, {r('h')} AS entropy,
  {r('CASE WHEN n <= 1 THEN 10 ELSE 2 + 8 * least(greatest(h / ln(n), 0), 1) END')} AS risk_aversion FROM (
  SELECT date, count(*) AS n, sum(-sh * ln(sh)) AS h FROM (
    SELECT date, s / sum(s) OVER (PARTITION BY date) AS sh FROM pick) GROUP BY 1)"""))
def signal_entropy(spark, d):
    e = W.signal_entropy(V.picks(spark, d))
    return e.select(day("as_of").alias("as_of"), num("entropy").alias("entropy"),
                    num("risk_aversion").alias("risk_aversion"))


@query("saturated_weights", Q.with_(PICK, final(capped(floored(
    "s / (greatest(km, 1e-9) + s) / vol",
    "(SELECT *, median(s) OVER (PARTITION BY date) AS km FROM pick)"), "0.05"))))
def saturated_weights(spark, d):
    p = W.saturated(V.picks(spark, d), "positive_signal", "_sat")
    return out(W.inverse_vol_weights(p.withColumn("positive_signal", F.col("_sat")), V.RULES))


def _barbell_over(spark, d, picked):
    """The denoised barbell on candidates whose signal has been transformed."""
    return out(denoise.denoised_weights(picked, V.prices(spark, d, "nation"), "market_id", V.RULES,
                                        aversion=W.signal_entropy(picked), top_k=5))


@query("saturated_barbell_weights")
def saturated_barbell_weights(spark, d):
    p = W.saturated(V.picks(spark, d), "positive_signal", "_sat")
    return _barbell_over(spark, d, p.withColumn("positive_signal", F.col("_sat")).drop("_sat"))


@query("shrunk_barbell_weights")
def shrunk_barbell_weights(spark, d):
    p = W.shrunk(V.picks(spark, d), "positive_signal", "_shr")
    return _barbell_over(spark, d, p.withColumn("positive_signal", F.greatest("_shr", F.lit(0.0))).drop("_shr"))


@query("decayed_barbell_weights")
def decayed_barbell_weights(spark, d):
    return _barbell_over(spark, d, V.decayed_picks(spark, d))


@query("decayed_weights", Q.with_(ACT, f"""
, dec AS (SELECT * EXCLUDE (sig), sig * least(greatest(exp(-least(greatest(date - en, 0), 252) / 63.0), 0.1), 1) AS sig FROM act),
dp AS (SELECT * FROM (SELECT *, greatest(sig, 0) AS s, row_number() OVER (PARTITION BY date ORDER BY greatest(sig, 0) DESC, ent) AS rk
  FROM dec WHERE greatest(sig, 0) >= 0.05) WHERE rk <= 100)
""".replace("\n, dec", ", dec", 1) + final(capped(floored("s / vol", "dp"), "0.05"))))
def decayed_weights(spark, d):
    return out(W.inverse_vol_weights(V.decayed_picks(spark, d), V.RULES))


@query("ensemble_weights", Q.with_(PICK, f"""
, a AS (SELECT date, ent, w FROM {capped(floored('s / vol', 'pick'), '0.05')} WHERE w > 0),
b AS (SELECT date, ent, w FROM {capped(floored(_BAR, 'pick'), '0.05')} WHERE w > 0),
u AS (SELECT date, ent, sum(w) / 2 AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2)
""".replace("\n, a AS", ", a AS", 1) + final(capped(floored("s", "u"), "0.05"))))
def ensemble_weights(spark, d):
    p = V.picks(spark, d)
    return out(W.ensemble_weights(W.inverse_vol_weights(p, V.RULES),
                                  W.barbell_weights(p, V.RULES), V.RULES))


@query("limited_turnover", Q.with_(PICK, f"""
, a AS (SELECT date, ent, w FROM {capped(floored('s / vol', 'pick'), '0.05')} WHERE w > 0),
b AS (SELECT date, ent, w FROM {capped(floored(_BAR, 'pick'), '0.05')} WHERE w > 0),
u AS (SELECT date, ent, sum(n) AS n, sum(o) AS o FROM (
  SELECT date, ent, w AS n, 0 AS o FROM a UNION ALL SELECT date, ent, 0, w FROM b) GROUP BY 1, 2),
t AS (SELECT date, sum(abs(n - o)) / 2 AS t FROM u GROUP BY 1)
SELECT date::VARCHAR AS as_of, ent AS internal_company_id,
  {r('o + (n - o) * coalesce(least(1, 0.02 / nullif(t, 0)), 1)')} AS weight FROM u JOIN t USING (date)
""".replace("\n, a AS", ", a AS", 1)))
def limited_turnover(spark, d):
    """From barbell holdings towards inverse volatility targets, as far as two per cent of turnover allow."""
    p = V.picks(spark, d)
    moved = W.limit_turnover(W.inverse_vol_weights(p, V.RULES), W.barbell_weights(p, V.RULES), 0.02)
    return moved.select(day("as_of").alias("as_of"), "internal_company_id", num("weight").alias("weight"))


@query("max_entropy_weights")
def max_entropy_weights(spark, d):
    return out(W.max_entropy_weights(V.picks(spark, d), V.RULES))


@query("denoised_cov_weights")
def denoised_cov_weights(spark, d):
    return out(denoise.denoised_weights(V.picks(spark, d), V.prices(spark, d, "nation"),
                                        "market_id", V.RULES))


@query("denoised_barbell_weights")
def denoised_barbell_weights(spark, d):
    p = V.picks(spark, d)
    return out(denoise.denoised_weights(p, V.prices(spark, d, "nation"), "market_id", V.RULES,
                                        aversion=W.signal_entropy(p), top_k=5))


@query("trailing_covariance")
def trailing_covariance(spark, d):
    rows = denoise.covariance_rows(V.picks(spark, d), V.prices(spark, d, "nation"), "market_id")
    total = F.aggregate("covariance", F.lit(0.0), lambda a, x: a + x)
    return rows.select(day("as_of").alias("as_of"), "internal_company_id",
                       num(total, 9).alias("covariance_row_sum"),
                       big(F.coalesce(F.size("covariance"), F.lit(0))).alias("names"))
