"""SQL fragments shared by the DuckDB counterparts of the driver queries."""

from __future__ import annotations

import re

from eventide.driver.registry import TIE_SHIFT


def r(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + {TIE_SHIFT!r}, {digits}) + 0.0)"


def sig_nine(x: str) -> str:
    """Numbers from 1000 on to nine significant digits, for values of very different size."""
    unit = f"pow(10, floor(log10(abs({x}))) - 8)"
    return f"CASE WHEN abs({x}) >= 1000 THEN round({x} / {unit}) * {unit} ELSE {x} END"


def nth(month: int, iso: int, n: int) -> str:
    first = f"make_date(y, {month}, 1)"
    return f"{first} + CAST((({iso} - isodow({first}) + 7) % 7 + {7 * (n - 1)}) AS INTEGER)"


def observed(month: int, d: int) -> str:
    x = f"make_date(y, {month}, {d})"
    return f"CASE isodow({x}) WHEN 6 THEN {x} - 1 WHEN 7 THEN {x} + 1 ELSE {x} END"


TRAIN_END, VALIDATION_END = "DATE '1998-12-31'", "DATE '1999-12-31'"

_FRAGMENTS: dict[str, str] = {}


def fragment(name: str, sql: str) -> None:
    _FRAGMENTS[name] = sql


def renamed(name: str, tables: tuple[str, ...], suffix: str) -> str:
    """A fragment's SQL that reads other tables: each of ``tables`` with the suffix."""
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(tables)})\b", rf"\1 \2{suffix}", _FRAGMENTS[name])


def with_(names: str, body: str) -> str:
    """``body`` prefixed with the named fragments, in the order given."""
    ctes = ",\n".join(f"{n} AS ({_FRAGMENTS[n]})" for n in names.split())
    return f"WITH {ctes}{body.lstrip()}" if body.lstrip().startswith(",") else f"WITH {ctes}\n{body}"


fragment("bounds", """
SELECT min(lo) AS lo, max(hi) AS hi FROM (
  SELECT min(o_orderdate)::DATE AS lo, max(o_orderdate)::DATE AS hi FROM orders
  UNION ALL SELECT min(l_shipdate)::DATE, max(l_shipdate)::DATE FROM lineitem)""")
fragment("years", "SELECT unnest(range(year(lo)::BIGINT, year(hi)::BIGINT + 1))::INTEGER AS y FROM bounds")
fragment("golden", """
SELECT y, y % 19 AS g, y // 100 AS c, y % 100 AS u FROM years""")
fragment("epact", """
SELECT y, g, u, c, (19 * g + c - c // 4 - (c - (c + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM golden""")
fragment("paschal", """
SELECT y, h, (32 + 2 * (c % 4) + 2 * (u // 4) - h - u % 4) % 7 AS w, g FROM epact""")
fragment("easter", """
SELECT y, make_date(y, (h + w - 7 * ((g + 11 * h + 22 * w) // 451) + 114) // 31,
  (h + w - 7 * ((g + 11 * h + 22 * w) // 451) + 114) % 31 + 1) AS d FROM paschal""")
fragment("holidays", f"""
SELECT {observed(1, 1)} AS d FROM years
UNION SELECT {nth(1, 1, 3)} FROM years UNION SELECT {nth(2, 1, 3)} FROM years
UNION SELECT d - 2 FROM easter
UNION SELECT CAST(last_day(make_date(y, 5, 1)) AS DATE)
   - CAST((isodow(last_day(make_date(y, 5, 1))) - 1) AS INTEGER) FROM years
UNION SELECT {observed(6, 19)} FROM years WHERE y >= 2021
UNION SELECT {observed(7, 4)} FROM years
UNION SELECT {nth(9, 1, 1)} FROM years UNION SELECT {nth(11, 4, 4)} FROM years
UNION SELECT {observed(12, 25)} FROM years""")
fragment("days", """
SELECT d AS date, isodow(d) < 6 AND d NOT IN (SELECT d FROM holidays) AS td FROM (
  SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM bounds)""")
fragment("cal", """
SELECT date, td, count(*) FILTER (WHERE td) OVER (ORDER BY date) - 1 AS seq,
  min(CASE WHEN td THEN date END) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_td,
  max(CASE WHEN td THEN date END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_td
FROM days""")
CAL = "bounds years golden epact paschal easter holidays days cal"

for _level, _key in (("region", "n_regionkey"), ("nation", "n_nationkey")):
    fragment(f"co_{_level}", f"""
SELECT 'COMP' || lpad(c_custkey::VARCHAR, 10, '0') AS ent, c_custkey, 'MKT' || {_key} AS mkt,
  n_regionkey::VARCHAR AS sector, c_mktsegment AS segment
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
    _day = f"""SELECT 'MKT' || {_key} AS mkt, l_shipdate::DATE AS date, sum(l_extendedprice) AS p, sum(l_quantity) AS q
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2"""
    fragment(f"px_{_level}", f"SELECT mkt, date, p / q AS px, q AS vol FROM ({_day})" if _level == "region" else f"""
SELECT mkt, date, sum(p) OVER w / sum(q) OVER w AS px, q AS vol FROM ({_day})
WINDOW w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""")
    fragment(f"fil_{_level}", f"""
SELECT o_orderkey::VARCHAR AS fid, ent, mkt, sector, segment, o_orderdate AS acc,
  o_orderdate::DATE AS ed, CASE WHEN o_orderpriority = '1-URGENT' THEN '10-K' ELSE '10-Q' END AS form,
  o_totalprice AS amount
FROM orders JOIN co_{_level} ON o_custkey = c_custkey""")
    fragment(f"ranked_{_level}", f"""
SELECT *, row_number() OVER (PARTITION BY ent, ed ORDER BY (form = '10-K') DESC, acc DESC, fid) AS rn
FROM fil_{_level}""")
    fragment(f"kept_{_level}", f"SELECT * FROM ranked_{_level} WHERE rn = 1")
    fragment(f"paired_{_level}", f"""
SELECT *, lead(fid) OVER (PARTITION BY ent ORDER BY ed) AS nfid,
  lead(ed) OVER (PARTITION BY ent ORDER BY ed) AS ned FROM kept_{_level}""")
    fragment(f"staged_{_level}", f"""
SELECT p.*, a.next_td AS en, b.prev_td AS ex, pe.px AS epx, pxx.px AS xpx,
  CASE WHEN nfid IS NULL THEN 'missing_next_event'
    WHEN a.next_td IS NULL OR b.prev_td IS NULL THEN 'insufficient_price_history'
    WHEN a.next_td >= b.prev_td THEN 'entry_after_exit'
    WHEN coalesce(pe.px, 0) <= 0 THEN 'missing_entry_price'
    WHEN coalesce(pxx.px, 0) <= 0 THEN 'missing_exit_price' END AS reason
FROM paired_{_level} p LEFT JOIN cal a ON a.date = ed LEFT JOIN cal b ON b.date = ned
LEFT JOIN px_{_level} pe ON pe.mkt = p.mkt AND pe.date = a.next_td
LEFT JOIN px_{_level} pxx ON pxx.mkt = p.mkt AND pxx.date = b.prev_td""")
    fragment(f"smp_{_level}", f"""
SELECT s.*, 'SAMPLE_' || substr(sha1(ent || '|' || fid), 1, 16) AS sid, ln(xpx / epx) AS ret,
  xpx / epx - 1 AS sret, cb.seq - ca.seq + 1 AS hold,
  CASE WHEN en <= {TRAIN_END} THEN 'train' WHEN en <= {VALIDATION_END} THEN 'validation' ELSE 'test' END AS split
FROM staged_{_level} s JOIN cal ca ON ca.date = en JOIN cal cb ON cb.date = ex WHERE reason IS NULL""")

    fragment(f"dr_{_level}", f"""
SELECT *, ln(px / lag(px) OVER w) AS lr, row_number() OVER w AS rn FROM px_{_level}
WINDOW w AS (PARTITION BY mkt ORDER BY date)""")
    fragment(f"dv_{_level}", f"""
SELECT mkt, date, CASE WHEN count(lr) OVER w >= 126 THEN stddev_samp(lr) OVER w END AS dvol
FROM dr_{_level} WINDOW w AS (PARTITION BY mkt ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""")
    fragment(f"evl_{_level}", f"""
SELECT *, list(ret) OVER (PARTITION BY ent ORDER BY en, sid ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS past
FROM smp_{_level}""")
    fragment(f"ev2_{_level}", f"""
SELECT *, list_aggregate(past, 'median') AS mid FROM evl_{_level}""")
    fragment(f"ev3_{_level}", f"""
SELECT *, list_aggregate(list_transform(past, lambda x: abs(x - mid)), 'median') AS mad FROM ev2_{_level}""")
    fragment(f"ev4_{_level}", f"""
SELECT *, CASE WHEN len(past) < 4 THEN NULL WHEN mad > 0 THEN 1.4826 * mad
  ELSE nullif(list_aggregate(past, 'stddev_samp'), 0) END AS evol FROM ev3_{_level}""")
    fragment(f"ev5_{_level}", f"""
SELECT s.*, v.dvol FROM ev4_{_level} s ASOF LEFT JOIN dv_{_level} v ON s.mkt = v.mkt AND s.en > v.date""")
    fragment(f"ev6_{_level}", f"""
SELECT *, dvol * sqrt(greatest(hold, 1)) AS sd FROM ev5_{_level}""")
    fragment(f"scl_{_level}", f"""
SELECT *, least(greatest(CASE WHEN evol IS NULL THEN sd WHEN sd IS NULL THEN evol
  ELSE 0.7 * sd + 0.3 * evol END, 0.02), 1.0) AS raw_scale,
  CASE WHEN evol IS NULL AND sd IS NULL THEN NULL ELSE least(greatest(
   CASE WHEN evol IS NULL THEN sd WHEN sd IS NULL THEN evol ELSE 0.7 * sd + 0.3 * evol END, 0.02), 1.0) END AS scale
FROM ev6_{_level}""")

fragment("index_px", """
SELECT 'SPY' AS sym, date, sum(px * vol) / sum(vol) AS px FROM px_region GROUP BY 2
UNION ALL SELECT 'QQQ', date, px FROM px_region WHERE mkt = 'MKT0'""")


def samples(level: str = "region") -> str:
    """Names of the fragments up to event samples."""
    return (f"{CAL} co_{level} px_{level} fil_{level} ranked_{level} kept_{level} "
            f"paired_{level} staged_{level} smp_{level}")


def scaled(level: str = "region") -> str:
    """Names of the fragments up to samples with an ex-ante scale (``scl_``)."""
    return samples(level) + "".join(
        f" {n}_{level}" for n in ("dr", "dv", "evl", "ev2", "ev3", "ev4", "ev5", "ev6", "scl"))


_FACT_ROWS = """
SELECT 'COMP' || lpad(o_custkey::VARCHAR, 10, '0') AS ent, l_returnflag AS tax, {concept} AS con,
  l_linestatus AS unit, l_extendedprice AS val, last_day(l_shipdate)::DATE AS pe,
  'Q' || quarter(l_shipdate)::VARCHAR AS fp,
  CASE o_orderpriority WHEN '1-URGENT' THEN 2 WHEN '5-LOW' THEN 0 ELSE 1 END AS fr,
  l_shipdate::DATE AS acc, l_orderkey * 8 + l_linenumber AS fact_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"""
for _k, _concept in (("fine", "p_brand"), ("coarse", "'ALL'")):
    fragment(f"fact_{_k}", _FACT_ROWS.format(concept=_concept))
    fragment(f"fmap_{_k}", f"""
SELECT 'feature_' || lpad((row_number() OVER (ORDER BY tax, con, unit) - 1)::VARCHAR, 6, '0') AS fid, * FROM (
  SELECT tax, con, unit, count(DISTINCT ent) AS nc, count(*) AS nf FROM fact_{_k}
  WHERE acc <= (SELECT max(acc)::DATE FROM smp_region WHERE split = 'train') GROUP BY ALL)
WHERE nc >= 20 AND 100.0 * nf / (SELECT count(*) FROM smp_region WHERE split = 'train') >= 1""")
    fragment(f"vis_{_k}", f"""
SELECT s.sid, s.split, s.en, m.fid, f.pe, f.val, f.acc, f.fp, row_number() OVER (
  PARTITION BY s.sid, m.fid, f.pe ORDER BY f.fr DESC, f.acc DESC, f.fact_id) AS rn
FROM smp_region s JOIN fact_{_k} f ON f.ent = s.ent AND f.acc <= s.acc::DATE
JOIN fmap_{_k} m ON m.tax = f.tax AND m.con = f.con AND m.unit = f.unit""")
    fragment(f"cell_{_k}", f"""
SELECT * FROM (SELECT *, dense_rank() OVER (PARTITION BY sid ORDER BY pe DESC) - 1 AS off
  FROM vis_{_k} WHERE rn = 1) WHERE off < 8""")
    fragment(f"stat_{_k}", f"""
SELECT off, fid, quantile_cont(sl, 0.5) AS med, quantile_cont(sl, 0.75) - quantile_cont(sl, 0.25) AS iqr FROM (
  SELECT *, sign(val) * ln(1 + abs(val)) AS sl FROM cell_{_k} WHERE split = 'train') GROUP BY 1, 2""")
    fragment(f"sca_{_k}", f"""
SELECT c.*, least(greatest((sign(val) * ln(1 + abs(val)) - coalesce(med, 0))
  / CASE WHEN iqr > 1e-9 * greatest(1, abs(coalesce(med, 0))) THEN iqr ELSE 1e-6 END, -10), 10) AS sval
FROM cell_{_k} c LEFT JOIN stat_{_k} s ON s.off = c.off AND s.fid = c.fid""")


def cells(kind: str = "fine") -> str:
    """Names of the fragments up to scaled fact cells (``cell_``, ``sca_``)."""
    return samples() + "".join(f" {n}_{kind}" for n in
                               ("fact", "fmap", "vis", "cell", "stat", "sca"))
