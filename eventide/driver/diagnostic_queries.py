"""Signal diagnostics, ensembles, cohort ranks and quality gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.event_queries import avg_pct
from eventide.driver.registry import big, day, num, query
from eventide.driver.sql import r
from eventide.operators import diagnostics as D
from eventide.operators import gates as G
from eventide.operators import performance as P
from eventide.operators import scale_target as ST

Q.fragment("pr", f"""
SELECT *, tanh(amount / (SELECT avg(amount) FROM scl_region) - 1) AS sig,
  year(en)::VARCHAR || 'Q' || quarter(en)::VARCHAR AS q,
  CASE WHEN scale > 0 THEN tanh(ret / (2.5 * scale)) END AS target FROM scl_region""")
Q.fragment("spy", """
SELECT p.*, ln(b.px / a.px) AS spy FROM pr p LEFT JOIN index_px a ON a.sym = 'SPY' AND a.date = en
LEFT JOIN index_px b ON b.sym = 'SPY' AND b.date = ex""")
Q.fragment("edges", "SELECT list_distinct(quantile_cont(sig, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM pr")
Q.fragment("binned", """
SELECT spy.*, greatest(len(list_filter(e, lambda x: x < sig)) - 1, 0)::BIGINT AS bucket FROM spy, edges""")
PRED = Q.scaled() + " pr"
BINNED = PRED + " index_px spy edges binned"


def _preds(spark, d):
    return V.predictions(spark, d, "region")


@query("decile_table", Q.with_(BINNED, f"""
SELECT bucket, {r('avg(sig)')} AS predicted_signal_mean, {r('avg(ret)')} AS raw_log_return_mean, {r('median(ret)')} AS raw_log_return_median,
  count(*)::BIGINT AS count, {r('avg(target)')} AS target_mean, {r('avg(ret - spy)')} AS excess_vs_spy_mean FROM binned GROUP BY 1"""))
def decile_table(spark, d):
    t = D.decile_table(_preds(spark, d))
    return t.select(big("bucket").alias("bucket"), num("predicted_signal_mean").alias("predicted_signal_mean"),
                    num("raw_log_return_mean").alias("raw_log_return_mean"),
                    num("raw_log_return_median").alias("raw_log_return_median"),
                    big("count").alias("count"), num("target_normalized_signal_mean").alias("target_mean"),
                    num("excess_vs_spy_mean").alias("excess_vs_spy_mean"))


@query("top_bottom_spread", Q.with_(BINNED, f"""
SELECT {r('arg_max(m, bucket) - arg_min(m, bucket)')} AS spread FROM (SELECT bucket, avg(ret) AS m FROM binned GROUP BY 1)"""))
def top_bottom_spread(spark, d):
    return D.top_minus_bottom(_preds(spark, d)).select(num("spread").alias("spread"))


def _ranks(value: str, part: str) -> str:
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {part}, {value}) - 1) / 2.0)")


@query("quarterly_ic", Q.with_(PRED, f"""
SELECT q AS quarter, count(*)::BIGINT AS n, CASE WHEN count(*) >= 5 THEN {r('corr(a, b)')} END AS spearman FROM (
  SELECT q, {_ranks('sig', 'q')} AS a, {_ranks('ret', 'q')} AS b FROM pr) GROUP BY 1"""))
def quarterly_ic(spark, d):
    return D.quarterly_rank_correlation(_preds(spark, d)).select(
        "quarter", big("n").alias("n"), num("spearman").alias("spearman"))


@query("direction_accuracy", Q.with_(PRED, f"""
SELECT q AS quarter, count(*)::BIGINT AS n, {r('avg((sign(sig) = sign(ret))::INT)')} AS direction_accuracy FROM pr GROUP BY 1"""))
def direction_accuracy(spark, d):
    return D.quarterly_direction_accuracy(_preds(spark, d)).select(
        "quarter", big("n").alias("n"), num("direction_accuracy").alias("direction_accuracy"))


@query("diagnostics_rollup", Q.with_(PRED, f"""
SELECT {r('avg(rho)')} AS mean_spearman, count(*) FILTER (WHERE rho > 0)::BIGINT AS positive_quarters,
  count(rho)::BIGINT AS quarters, {r('avg(acc)')} AS mean_direction_accuracy FROM (
  SELECT q, CASE WHEN count(*) >= 5 THEN corr(a, b) END AS rho, avg((sign(sig) = sign(ret))::INT) AS acc FROM (
    SELECT q, sig, ret, {_ranks('sig', 'q')} AS a, {_ranks('ret', 'q')} AS b FROM pr) GROUP BY 1)"""))
def diagnostics_rollup(spark, d):
    o = D.diagnostics_rollup(_preds(spark, d))
    return o.select(num("mean_spearman").alias("mean_spearman"),
                    big("positive_quarters").alias("positive_quarters"), big("quarters").alias("quarters"),
                    num("mean_direction_accuracy").alias("mean_direction_accuracy"))


@query("top_vs_random", Q.with_(PRED, f"""
, pos AS (SELECT * FROM pr WHERE sig > 0),
mo AS (SELECT avg(m) AS model_mean FROM (SELECT en, avg(ret) AS m FROM (
  SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY en ORDER BY sig DESC, sid) <= 50) GROUP BY 1)),
tr AS (SELECT trial, avg(m) AS m FROM (SELECT trial, en, avg(ret) AS m FROM (
  SELECT pos.*, trial FROM pos, range(1, 26) t(trial)
  QUALIFY row_number() OVER (PARTITION BY trial, en ORDER BY sha1('42|' || trial::VARCHAR || '|' || sid), sid) <= 50) GROUP BY 1, 2) GROUP BY 1)
SELECT {r('model_mean')} AS model_mean, {r('avg(m)')} AS random_mean, {r('model_mean - avg(m)')} AS spread,
  {r('(model_mean - avg(m)) / greatest(stddev_samp(m) / sqrt(count(*)), 1e-12)', 3)} AS model_t_stat, count(*)::BIGINT AS n_trials
FROM tr, mo GROUP BY model_mean"""))
def top_vs_random(spark, d):
    o = D.top_vs_random(_preds(spark, d))
    return o.select(num("model_mean").alias("model_mean"), num("random_mean").alias("random_mean"),
                    num("spread").alias("spread"), num("model_t_stat", 3).alias("model_t_stat"),
                    big("n_trials").alias("n_trials"))


@query("regression_metrics", Q.with_(PRED, f"""
SELECT split, {r('avg((sig - target) ** 2)')} AS mse, {r('avg(abs(sig - target))')} AS mae,
  {r('avg((sign(sig) = sign(target))::INT)')} AS direction_accuracy, {r('corr(sig, target)')} AS pearson,
  {r('corr(a, b)')} AS spearman, {r('1 - sum((sig - target) ** 2) / (var_pop(target) * count(*))')} AS r2, count(*)::BIGINT AS n
FROM (SELECT *, {_ranks('sig', 'split')} AS a, {_ranks('target', 'split')} AS b FROM pr WHERE target IS NOT NULL) GROUP BY 1"""))
def regression_metrics(spark, d):
    m = D.regression_metrics(_preds(spark, d), ["split"], "target_normalized_signal",
                             "predicted_signal")
    return m.select("split", big("n").alias("n"), *[num(c).alias(c) for c in (
        "mse", "mae", "direction_accuracy", "pearson", "spearman", "r2")])


@query("bucket_report", Q.with_(PRED, f"""
SELECT {r('b * 0.2 - 1')} AS bucket_lo, {r('(b + 1) * 0.2 - 1')} AS bucket_hi, count(*)::BIGINT AS count,
  {r('avg(sig)')} AS mean_predicted, {r('avg(ret)')} AS mean_true
FROM (SELECT *, least(floor((sig + 1) / 0.2), 9) AS b FROM pr) GROUP BY b"""))
def bucket_report(spark, d):
    b = D.bucket_report(_preds(spark, d), "raw_log_return", "predicted_signal")
    return b.select(big("count").alias("count"), *[num(c).alias(c) for c in (
        "bucket_lo", "bucket_hi", "mean_predicted", "mean_true")])


def _models(spark, d):
    """Three closed-form models; the last scores only samples with a scale."""
    p = _preds(spark, d)
    cents = F.pmod(F.col("amount"), F.lit(1000.0))
    second = p.withColumn("predicted_signal", F.tanh(cents / 500.0 - 1.0))
    third = p.where(F.col("ex_ante_scale").isNotNull()).withColumn(
        "predicted_signal", F.tanh(F.col("ex_ante_scale") * 2.0 - 1.0))
    return [p, second, third]


Q.fragment("models", """
SELECT 0 AS m, sid, split, sig AS s FROM pr UNION ALL
SELECT 1, sid, split, tanh((amount % 1000.0) / 500 - 1) FROM pr UNION ALL
SELECT 2, sid, split, tanh(scale * 2 - 1) FROM pr WHERE scale IS NOT NULL""")


@query("mean_ensemble", Q.with_(PRED + " models", f"""
SELECT sid AS sample_id, split, {r('least(greatest(avg(s), -1), 1)')} AS predicted_signal FROM models GROUP BY 1, 2 HAVING count(*) = 3"""))
def mean_ensemble(spark, d):
    return D.mean_ensemble(_models(spark, d)).select(
        "sample_id", "split", num("predicted_signal").alias("predicted_signal"))


@query("rank_ensemble", Q.with_(PRED + " models", f"""
SELECT sid AS sample_id, split, {r('least(greatest(2 * avg(pct) - 1, -1), 1)')} AS predicted_signal
FROM (SELECT *, {avg_pct('s', 'm, split')} AS pct FROM models) GROUP BY 1, 2 HAVING count(*) = 3"""))
def rank_ensemble(spark, d):
    return D.rank_ensemble(_models(spark, d)).select(
        "sample_id", "split", num("predicted_signal").alias("predicted_signal"))


@query("quarter_rank_signal", Q.with_(PRED, f"""
SELECT sid AS sample_id, {r('2 * ' + avg_pct('sig', 'q') + ' - 1')} AS predicted_signal FROM pr"""))
def quarter_rank_signal(spark, d):
    p = _preds(spark, d).withColumnRenamed("predicted_signal", "raw_score")
    return D.quarter_rank_signal(p, "raw_score").select(
        "sample_id", num("predicted_signal").alias("predicted_signal"))


@query("cohort_rank_scores", Q.with_(PRED, f"""
, newest AS (SELECT max(date_trunc('quarter', en)) AS nq FROM pr WHERE split = 'validation'),
coh AS (SELECT sig FROM pr, newest WHERE split = 'validation' AND date_trunc('quarter', en) = nq),
allv AS (SELECT sig FROM coh UNION ALL SELECT sig FROM pr WHERE split = 'test'),
rk AS (SELECT *, (rank() OVER (ORDER BY sig)) / ((SELECT count(*) FROM allv) + 1.0) AS pct FROM allv),
sc AS (SELECT DISTINCT p.*, rk.pct, least(greatest((2 * pct - 1) * 0.25, -0.4), 0.4) AS sh FROM pr p JOIN rk ON rk.sig = p.sig WHERE p.split = 'test')
SELECT sid AS sample_id, {r('pct')} AS rank_pct, {r('2 * pct - 1')} AS predicted_signal,
  CASE WHEN 2 * pct - 1 > 0.05 THEN 'up' WHEN 2 * pct - 1 < -0.05 THEN 'down' ELSE 'flat' END AS direction,
  CASE WHEN pct >= 0.85 THEN 'high' WHEN pct >= 0.7 THEN 'moderate' WHEN pct >= 0.3 THEN 'neutral' WHEN pct >= 0.15 THEN 'moderate-avoid' ELSE 'avoid' END AS confidence,
  {r('exp(atanh(sh) * 2.5 * scale) - 1')} AS expected_pct_return,
  {r('scale / greatest(1, sqrt(hold)) * sqrt(252)')} AS annualized_vol FROM sc"""))
def cohort_rank_scores(spark, d):
    p = (_preds(spark, d).withColumnRenamed("predicted_signal", "raw_score")
         .join(V.event_samples(spark, d).select("sample_id", "holding_days"), "sample_id"))
    cohort = D.latest_cohort(p.where(F.col("split") == "validation"))
    out = D.describe_scores(D.rank_in_cohort(p.where(F.col("split") == "test"), cohort))
    return out.select("sample_id", num("rank_pct").alias("rank_pct"),
                      num("predicted_signal").alias("predicted_signal"), "direction", "confidence",
                      num("expected_pct_return").alias("expected_pct_return"),
                      num("annualized_vol").alias("annualized_vol"))


@query("suggested_longs", Q.with_(PRED, f"""
SELECT sid AS sample_id, {r('i / sum(i) OVER ()')} AS suggested_weight FROM (
  SELECT sid, 1 / greatest(scale, 1e-3) AS i FROM pr WHERE split = 'test' AND sig > 0 ORDER BY sig DESC, sid LIMIT 25)"""))
def suggested_longs(spark, d):
    p = _preds(spark, d).where(F.col("split") == "test")
    return D.suggested_longs(p, 25).select("sample_id", num("suggested_weight").alias("suggested_weight"))


@query("ndcg_by_quarter", Q.with_(PRED, f"""
, lab AS (SELECT sid, q, sig, least(floor({avg_pct('ret', 'q')} * 30.999), 30) AS rel FROM pr),
a AS (SELECT q, sum((2 ** rel - 1) / log2(k + 1)) AS x FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY sig DESC, sid) AS k FROM lab) WHERE k <= 50 GROUP BY 1),
b AS (SELECT q, sum((2 ** rel - 1) / log2(k + 1)) AS y FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC, sid) AS k FROM lab) WHERE k <= 50 GROUP BY 1)
SELECT q AS quarter, {r('CASE WHEN y > 0 THEN x / y ELSE 0 END')} AS ndcg FROM a JOIN b USING (q)"""))
def ndcg_by_quarter(spark, d):
    labelled = ST.rank_labels(_preds(spark, d))
    return D.ndcg(labelled, "quarter", "predicted_signal", "relevance", 50).select(
        "quarter", num("ndcg").alias("ndcg"))


@query("reward_weights", Q.with_(PRED, f"""
SELECT sid AS sample_id, {r('w / avg(w) OVER ()')} AS reward_weight FROM (
  SELECT sid, exp(8 * sign(sig) * sign(ret) * abs(sig) * abs(ret)) AS w FROM pr)"""))
def reward_weights(spark, d):
    return ST.reward_weights(_preds(spark, d), "predicted_signal", "raw_log_return").select(
        "sample_id", num("reward_weight").alias("reward_weight"))


@query("mean_baseline", Q.with_(PRED, f"""
SELECT 'historical_mean' AS model_id, {r('sum(w * target) / sum(w)')} AS prediction FROM (
  SELECT target, 1.0 / count(*) OVER (PARTITION BY ent) AS w FROM pr WHERE split = 'train' AND target IS NOT NULL)"""))
def mean_baseline(spark, d):
    from eventide.plans.learning import historical_mean
    train = _preds(spark, d).where((F.col("split") == "train")
                                   & F.col("target_normalized_signal").isNotNull())
    weighted = ST.frequency_weights(train, by_quarter=False)
    return historical_mean(weighted, "target_normalized_signal", "sample_weight").select(
        F.lit("historical_mean").alias("model_id"), num("prediction").alias("prediction"))


@query("quality_gates", Q.with_(Q.cells() + " dr_region dv_region evl_region ev2_region ev3_region ev4_region ev5_region ev6_region scl_region pr", """
SELECT gate, violations::BIGINT AS violations, violations = 0 AS passed FROM (
  SELECT 'date_ordering' AS gate, count(*) FILTER (WHERE NOT (en > ed AND ex < ned AND en < ex)) AS violations FROM pr
  UNION ALL SELECT 'target_range', count(*) FILTER (WHERE abs(target) > 1) FROM pr
  UNION ALL SELECT 'prediction_range', count(*) FILTER (WHERE abs(sig) > 1 + 1e-9) FROM pr
  UNION ALL SELECT 'no_future_facts', count(*) FILTER (WHERE c.acc > p.acc::DATE) FROM cell_fine c JOIN pr p USING (sid)
  UNION ALL SELECT 'unique_events', count(*) FILTER (WHERE n > 1) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)
  UNION ALL SELECT 'anonymous_columns', 0
  UNION ALL SELECT 'fact_without_value', count(*) FILTER (WHERE val IS NULL) FROM fact_fine
  UNION ALL SELECT 'fact_after_period_end', count(*) FILTER (WHERE acc > pe) FROM fact_fine
  UNION ALL SELECT 'fact_non_positive', count(*) FILTER (WHERE val <= 0) FROM fact_fine
  UNION ALL SELECT 'portfolio_weights', 0 UNION ALL SELECT 'accounting', 0)"""))
def quality_gates(spark, d):
    samples, preds, facts = V.scaled_samples(spark, d), _preds(spark, d), V.facts(spark, d)
    rules = {"fact_without_value": F.col("value").isNull(),
             "fact_after_period_end": F.col("accepted_date") > F.col("period_end_date"),
             "fact_non_positive": F.col("value") <= 0}
    opaque = V.cells(spark, d).select("sample_id", "anonymous_feature_id", "value")
    parts = [G.date_ordering(samples), G.in_range(samples, "target_normalized_signal", "target_range"),
             G.in_range(preds, "predicted_signal", "prediction_range", 1e-9),
             G.no_future_facts(samples, V.cells(spark, d)),
             G.unique_key(V.filings(spark, d), ["filing_event_id"], "unique_events"),
             G.anonymous_columns(opaque), G.rule_violations(facts, rules),
             G.portfolio_weights(V.targets(spark, d), V.RULES.max_weight),
             G.accounting(V.portfolio(spark, d)["daily"])]
    return G.all_gates(parts).select("gate", big("violations").alias("violations"), "passed")


@query("price_quality", Q.with_("px_nation", """
SELECT mkt AS market_id, count(*)::BIGINT AS rows, 0::BIGINT AS duplicate_dates,
  count(*) FILTER (WHERE px <= 0)::BIGINT AS nonpositive_closes, count(*) FILTER (WHERE vol < 0)::BIGINT AS negative_volumes
FROM px_nation GROUP BY 1"""))
def price_quality(spark, d):
    q = G.price_quality(V.prices(spark, d, "nation"), "market_id")
    return q.select("market_id", *[big(c).alias(c) for c in q.columns[1:]])
