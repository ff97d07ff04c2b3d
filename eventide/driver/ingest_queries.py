"""Document parsing, price files, identifiers and incremental jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.registry import big, day, num, query
from eventide.driver.sql import r
from eventide.functions import scalars as S
from eventide.operators import events
from eventide.session import scratch_path
from eventide.sources import documents as docs
from eventide.sources import tables
from eventide.streaming import incremental as inc
from eventide.streaming import refresh as ref

BLOCK = 64  # rows per generated document, so that no customer becomes one huge document


@query("json_events", f"""
SELECT event_id, user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {r('value', 4)} AS value FROM events""")
def json_events(spark, d):
    e = V.table(spark, d, "events")
    parsed = F.from_json("props", "k string")
    return e.select("event_id", "user_id", "event_type",
                    parsed["k"].try_cast("bigint").alias("k"), num("value", 4).alias("value"))


@query("company_directory", """
SELECT 'COMP' || lpad(c_custkey::VARCHAR, 10, '0') AS internal_company_id, lpad(c_custkey::VARCHAR, 10, '0') AS cik,
  'TK' || upper(c_mktsegment) || c_custkey AS ticker, c_name AS company_name FROM customer""")
def company_directory(spark, d):
    c = V.table(spark, d, "customer")
    item = F.struct(F.col("c_custkey").alias("cik_str"), F.concat(
        F.lit("tk"), F.lower("c_mktsegment"), F.col("c_custkey")).alias("ticker"),
        F.col("c_name").alias("title"))
    raw = (c.groupBy(F.floor(F.col("c_custkey") / BLOCK).alias("b"))
           .agg(F.to_json(F.map_from_entries(F.collect_list(
               F.struct(F.col("c_custkey").cast("string"), item)))).alias("raw")))
    return docs.company_directory(raw).select("internal_company_id", "cik", "ticker", "company_name")


_FORM = "CASE o_orderpriority WHEN '1-URGENT' THEN '10-K' WHEN '5-LOW' THEN '10-Q/A' WHEN '4-NOT SPECIFIED' THEN '8-K' ELSE '10-Q' END"


def event_documents(spark, d):
    """Orders as documents of parallel arrays, in pages per customer."""
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.expr(_FORM).alias("form"),
                                           F.col("o_orderdate").alias("at"))
    text = F.date_format("at", "yyyy-MM-dd")
    e = F.struct(F.col("o_orderkey").cast("string").alias("a"), "form", text.alias("d"),
                 F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    pages = (o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / BLOCK).alias("page"))
             .agg(F.collect_list(e).alias("e")))
    each = {"accessionNumber": "a", "form": "form", "filingDate": "d", "reportDate": "d",
            "acceptanceDateTime": "t", "primaryDocument": "a", "isXBRL": "a", "isInlineXBRL": "a"}
    recent = F.struct(*[F.col(f"e.{v}").alias(k) for k, v in each.items()])
    return pages.select(F.to_json(F.struct(
        F.col("o_custkey").alias("cik"), (F.col("o_custkey") % 9000 + 100).alias("sic"),
        F.struct(recent.alias("recent")).alias("filings"))).alias("raw"))


@query("parsed_events", f"""
SELECT 'FILING_' || substr(sha1(lpad(o_custkey::VARCHAR, 10, '0') || '|' || o_orderkey), 1, 16) AS filing_event_id,
  lpad(o_custkey::VARCHAR, 10, '0') AS cik, o_orderkey::VARCHAR AS accession_number, form AS form_type,
  o_orderdate::DATE::VARCHAR AS filed_date, form LIKE '%/A' AS is_amendment
FROM (SELECT *, {_FORM} AS form FROM orders) WHERE form <> '8-K'""")
def parsed_events(spark, d):
    e = docs.event_list(event_documents(spark, d), include_amendments=True)
    e = docs.first_per_key(e, "filing_event_id", ["accession_number"])
    return e.select("filing_event_id", "cik", "accession_number", "form_type",
                    day("filed_date").alias("filed_date"), "is_amendment")


_SPREAD = "o_orderdate + to_hours((o_orderkey * 7 % 24)::INTEGER)"
_SPREAD_EVENTS = f"""
SELECT 'FILING_' || substr(sha1(lpad(o_custkey::VARCHAR, 10, '0') || '|' || o_orderkey), 1, 16) AS fid, ent, mkt, sector, segment,
  CASE WHEN o_orderkey % 2 = 0 THEN {_SPREAD} ELSE (({_SPREAD}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC' END AS acc,
  CASE WHEN o_orderkey % 2 = 0 THEN (({_SPREAD}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE {_SPREAD} END::DATE AS ed,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '10-K' ELSE '10-Q' END AS form, o_totalprice AS amount
FROM orders JOIN co_region ON o_custkey = c_custkey"""


@query("samples_from_documents", Q.with_(Q.samples(), f"""
SELECT sid AS sample_id, ed::VARCHAR AS event_day, en::VARCHAR AS entry_date, ex::VARCHAR AS exit_date,
  {r('ret')} AS raw_log_return FROM smp_region""").replace(Q._FRAGMENTS["fil_region"], _SPREAD_EVENTS))
def samples_from_documents(spark, d):
    """Parsed events straight into the sample builder; times spread over the day, every second one without a zone."""
    o = V.table(spark, d, "orders")
    wall = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") * 7 % 24).cast("int"))
    text = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("o_orderkey") % 2 == 0, "Z").otherwise(""))
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").otherwise("10-Q")
    e = F.struct(F.col("o_orderkey").cast("string").alias("a"), form.alias("form"),
                 F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), text.alias("t"))
    pages = (o.groupBy("o_custkey", F.floor(F.col("o_orderkey") / BLOCK).alias("page")).agg(F.collect_list(e).alias("e")))
    each = {"accessionNumber": "a", "form": "form", "filingDate": "d", "reportDate": "d",
            "acceptanceDateTime": "t", "primaryDocument": "a", "isXBRL": "a", "isInlineXBRL": "a"}
    recent = F.struct(*[F.col(f"e.{v}").alias(k) for k, v in each.items()])
    raw = pages.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.struct(recent.alias("recent")).alias("filings"))).alias("raw"))
    parsed = docs.event_list(raw).join(V.companies(spark, d), "internal_company_id")
    samples = events.build_event_samples(parsed, V.prices(spark, d), V.calendar(spark, d), train_end=V.TRAIN_END,
                                         validation_end=V.VALIDATION_END, price_key="market_id")[0]
    return samples.select("sample_id", day("report_event_date").alias("event_day"), day("entry_date").alias("entry_date"),
                          day("exit_date").alias("exit_date"), num("raw_log_return").alias("raw_log_return"))


@query("sector_table", """
SELECT DISTINCT lpad(o_custkey::VARCHAR, 10, '0') AS cik, (o_custkey % 9000 + 100)::VARCHAR AS sic,
  substr(lpad((o_custkey % 9000 + 100)::VARCHAR, 4, '0'), 1, 1) AS sic_division FROM orders""")
def sector_table(spark, d):
    return docs.sector_table(event_documents(spark, d)).select("cik", "sic", "sic_division").distinct()


@query("nested_facts", f"""
SELECT 'FACT_' || substr(sha1(lpad(o_custkey::VARCHAR, 10, '0') || '|' || l_returnflag || '|' || p_brand || '|' || o_orderkey || '-' || l_linenumber || '|' || last_day(l_shipdate)::DATE::VARCHAR || '|' || l_linestatus || '|' || l_shipdate::DATE::VARCHAR), 1, 20) AS fact_id,
  lpad(o_custkey::VARCHAR, 10, '0') AS cik, l_returnflag AS taxonomy, p_brand AS concept_name, l_linestatus AS unit,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE {r('l_extendedprice', 2)} END AS value, last_day(l_shipdate)::DATE::VARCHAR AS period_end_date,
  year(l_shipdate)::BIGINT AS fiscal_year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""")
def nested_facts(spark, d):
    """Lines nested as taxonomy -> concept -> unit -> observations, then flattened again.

    Values of every seventh line are written as text that is no number.
    """
    li = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                              "l_returnflag", "l_linestatus", "l_extendedprice",
                                              F.col("l_shipdate").cast("timestamp").cast("date").alias("ship"))
    rows = (li.join(V.table(spark, d, "orders").select("o_orderkey", "o_custkey"),
                    F.col("l_orderkey") == F.col("o_orderkey"))
            .join(V.table(spark, d, "part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey")))
    value = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    obs = F.struct(F.col("ship").cast("string").alias("start"),
                   F.last_day("ship").cast("string").alias("end"), value.alias("val"),
                   F.concat_ws("-", "o_orderkey", "l_linenumber").alias("accn"),
                   F.year("ship").alias("fy"), F.lit("10-Q").alias("form"),
                   F.col("ship").cast("string").alias("filed"))
    page = ["o_custkey", "page"]
    # Lines meet by document as plain columns; text is made and nested where they are.
    rows = rows.withColumn("page", F.floor(F.col("o_orderkey") / BLOCK)).select(
        *page, "o_orderkey", "l_linenumber", "l_returnflag", "p_brand", "l_linestatus", "l_extendedprice", "ship").repartition(*page)
    units = rows.groupBy(*page, "l_returnflag", "p_brand", "l_linestatus").agg(
        F.collect_list(obs).alias("o"))
    nest = lambda df, keys, k, v, out: df.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(k, v))).alias(out))
    concepts = nest(units, [*page, "l_returnflag", "p_brand"], "l_linestatus", "o", "units")
    taxa = nest(concepts.withColumn("u", F.struct("units")), [*page, "l_returnflag"], "p_brand", "u", "c")
    whole = nest(taxa, page, "l_returnflag", "c", "facts")
    raw = whole.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), "facts")).alias("raw"))
    f = docs.fact_documents(raw)
    return f.select("fact_id", "cik", "taxonomy", "concept_name", "unit", num("value", 2).alias("value"),
                    day("period_end_date").alias("period_end_date"), big("fiscal_year").alias("fiscal_year"))


@query("identifiers", f"""
SELECT e.event_id, lpad(user_id::VARCHAR, 10, '0') AS entity_key, 'COMP' || lpad(user_id::VARCHAR, 10, '0') AS entity_id,
  'ID_' || substr(sha1(user_id::VARCHAR || '|' || event_type || '|'), 1, 16) AS hashed,
  substr(lpad(event_id::VARCHAR, 4, '0'), 1, 1) AS division,
  CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS DATE)::VARCHAR AS eastern_day,
  {r('sign(value - 20) * ln(1 + abs(value - 20))')} AS signed_log FROM events e""")
def identifiers(spark, d):
    e = V.table(spark, d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.withColumn("iso", iso).select(
        "event_id", S.normalize_entity_key(F.concat(F.lit("CIK "), "user_id", F.lit("/v2")))
        .alias("entity_key"), S.entity_id("user_id").alias("entity_id"),
        S.hash_id("ID_", ["user_id", "event_type", F.lit(None).cast("string")], 16).alias("hashed"),
        S.industry_division(F.concat(F.lit("sic-"), "event_id")).alias("division"),
        day(S.eastern_date("iso")).alias("eastern_day"),
        num(S.signed_log(F.col("value") - 20)).alias("signed_log"))


@query("csv_prices", Q.with_("px_nation", f"""
SELECT mkt AS ticker_at_date, date::VARCHAR AS date, {r('px')} AS adjusted_close, {r('vol')} AS volume
FROM px_nation WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"""))
def csv_prices(spark, d):
    """Prices written as CSV per ticker, in two column orders, and read back with a date window."""
    path = scratch_path(spark, "csv")
    p = V.prices(spark, d, "nation")
    close = F.col("adjusted_close")
    columns = {"date": F.col("date"), "open": close, "high": close, "low": close, "close": close,
               "adjusted_close": close, "volume": F.col("volume")}
    layouts = (list(columns), ["volume", "adjusted_close", *[c for c in columns if c not in ("volume", "adjusted_close")]])
    for k, names in enumerate(layouts):
        (p.where(F.pmod(F.crc32(F.col("market_id").cast("binary")), F.lit(2)) == k)
         .select(F.lower("market_id").alias("ticker"), *[columns[c].alias(c) for c in names])
         .write.mode("append").partitionBy("ticker").option("header", True).csv(path))
    out = tables.read_prices_csv(spark, path, "1997-01-01", "1999-12-31", ticker_column="ticker")
    return out.select("ticker_at_date", day("date").alias("date"),
                      num("adjusted_close").alias("adjusted_close"), num("volume").alias("volume"))


@query("table_manifest", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*)::BIGINT AS rows FROM {t}"
    for t in ("customer", "events", "lineitem", "orders")))
def table_manifest(spark, d):
    return tables.manifest({t: V.table(spark, d, t) for t in ("customer", "events", "lineitem", "orders")}
                           ).select("table", big("rows").alias("rows"))


_STAMP = "'%Y-%m-%d %H:%M:%S'"


@query("new_event_detection", f"""
SELECT user_id, coalesce(strftime(p, {_STAMP}), '') AS previous, strftime(c, {_STAMP}) AS current FROM (
  SELECT user_id, max(ts) AS c, max(ts) FILTER (WHERE ts < TIMESTAMP '2024-01-20' AND user_id % 3 = 0) AS p FROM events GROUP BY 1)
WHERE p IS NULL OR c > p""")
def new_event_detection(spark, d):
    """All events against marks kept for every third user on 20 January."""
    e = V.table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    known = e.where((F.col("ts") < F.lit("2024-01-20").cast("timestamp")) & (F.col("user_id") % 3 == 0))
    state = inc.latest_per_entity(known, "user_id", "ts")
    text = lambda c: F.date_format(F.date_trunc("second", c), "yyyy-MM-dd HH:mm:ss")
    return inc.new_events(e, state, "user_id", "ts").select(
        "user_id", F.coalesce(text("previous"), F.lit("")).alias("previous"),
        text("current").alias("current"))


def _event_stream(spark, d):
    path = f"{d}/events.parquet"
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            .option("pathGlobFilter", "events.parquet").parquet(d)
            .withColumn("ts", F.col("ts").cast("timestamp")))


@query("stream_new_events", """
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS current FROM events GROUP BY 1""")
def stream_new_events(spark, d):
    """The same detection as a streaming job starting without marks."""
    base = scratch_path(spark, "stream")
    q = inc.detect_new_events(_event_stream(spark, d), "user_id", "ts", f"{base}/state",
                              f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(
        "user_id", F.date_format(F.date_trunc("second", "current"), "yyyy-MM-dd HH:mm:ss").alias("current"))


@query("stream_dedupe", f"SELECT event_id, user_id, event_type, {r('value', 4)} AS value FROM events")
def stream_dedupe(spark, d):
    """Every event delivered twice; each comes out once."""
    base = scratch_path(spark, "dedupe")
    twice = _event_stream(spark, d).unionByName(_event_stream(spark, d))
    once = inc.without_redelivered(twice, "event_id", "ts", "40 days")
    q = (once.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start(f"{base}/out"))
    q.awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{base}/out").select(
        "event_id", "user_id", "event_type", num("value", 4).alias("value"))


@query("changed_entity_refresh", """
SELECT user_id, count(*)::BIGINT AS events, count(DISTINCT event_type)::BIGINT AS kinds FROM events
WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-28') GROUP BY 1""")
def changed_entity_refresh(spark, d):
    """Recompute per-user facts only for users with events since 28 January."""
    e = V.table(spark, d, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    state = inc.latest_per_entity(e.where(F.col("ts") < F.lit("2024-01-28").cast("timestamp")),
                                  "user_id", "ts")
    changed = inc.new_events(e, state, "user_id", "ts")
    return inc.refresh_changed(changed, e, "user_id", lambda x: x.groupBy("user_id").agg(
        big(F.count(F.lit(1))).alias("events"), big(F.countDistinct("event_type")).alias("kinds")))


@query("stream_fact_refresh", """
WITH e AS (SELECT *, event_id % 3 AS b FROM events),
m AS (SELECT user_id, max(ts) FILTER (b = 0) AS m0, max(ts) FILTER (b = 1) AS m1, max(ts) FILTER (b = 2) AS m2 FROM e GROUP BY 1),
f AS (SELECT user_id, CASE WHEN m2 > coalesce(greatest(m0, m1), TIMESTAMP '1900-01-01') THEN 2
  WHEN m1 > coalesce(m0, TIMESTAMP '1900-01-01') THEN 1 ELSE 0 END AS refreshed_in FROM m)
SELECT user_id, refreshed_in::BIGINT AS refreshed_in, count(*)::BIGINT AS events, count(DISTINCT event_type)::BIGINT AS kinds
FROM e JOIN f USING (user_id) WHERE b <= refreshed_in GROUP BY ALL""")
def stream_fact_refresh(spark, d):
    """Facts per user kept fresh by a streaming job.

    All events arrive out of time order in three deliveries and the second once more.
    A user's facts are those of the last delivery that held an event newer than all
    before it; the repeated delivery changes nothing.
    """
    base = scratch_path(spark, "refresh")
    e = V.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    delivery = F.col("event_id") % 3
    buckets = 8 + e.agg(F.approx_count_distinct("user_id")).first()[0] // 100_000
    for b in (0, 1, 2, 1):
        e.where(delivery == b).write.mode("append").parquet(f"{base}/arrived")
        stream = spark.readStream.schema(e.schema).parquet(f"{base}/arrived")
        ref.refresh_facts(
            stream, "user_id", "ts", base,
            lambda changed, b=b: inc.refresh_changed(changed, e.where(delivery <= b), "user_id", lambda x: x.groupBy(
                "user_id").agg(big(F.count(F.lit(1))).alias("events"), big(F.countDistinct("event_type")).alias("kinds"))),
            buckets).awaitTermination()
    return ref.read_facts(spark, base, "user_id").select("user_id", big("refreshed_in").alias("refreshed_in"), "events", "kinds")


@query("cycle_digest", Q.with_(Q.scaled() + " pr", f"""
SELECT item, {r('value')} AS value FROM (
  SELECT 'watched' AS item, count(*)::DOUBLE AS value FROM customer
  UNION ALL SELECT 'new_events', count(*)::DOUBLE FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_orderdate) > DATE '2001-01-01')
  UNION ALL SELECT * FROM (SELECT sid, sig FROM pr WHERE split = 'test' AND sig > 0 ORDER BY sig DESC, sid LIMIT 10))"""))
def cycle_digest(spark, d):
    f = V.filings(spark, d)
    state = inc.latest_per_entity(f, "internal_company_id", "accepted_datetime").select(
        "internal_company_id", F.least("latest", V.eastern_mark("2001-01-01")).alias("latest"))
    new = inc.new_events(f, state, "internal_company_id", "accepted_datetime")
    scores = V.predictions(spark, d, "region").where(F.col("split") == "test")
    return inc.digest(new, scores, V.table(spark, d, "customer")).select("item", num("value").alias("value"))


_CYCLES = ("1999-01-01", "2000-01-01")


@query("cycle_digests", Q.with_(Q.scaled() + " pr", f"""
, cyc AS (SELECT o_custkey, CASE WHEN o_orderdate < DATE '{_CYCLES[0]}' THEN 0 WHEN o_orderdate < DATE '{_CYCLES[1]}' THEN 1 ELSE 2 END AS b FROM orders),
newest AS (SELECT b, sid, sig FROM (SELECT DISTINCT b FROM cyc) JOIN pr ON CASE WHEN b = 2 THEN TRUE WHEN b = 1 THEN en < DATE '{_CYCLES[1]}' ELSE en < DATE '{_CYCLES[0]}' END
  QUALIFY row_number() OVER (PARTITION BY b, ent ORDER BY en DESC, sid) = 1)
SELECT b::BIGINT AS cycle, item, {r('value')} AS value FROM (
  SELECT b, 'watched' AS item, (SELECT count(*) FROM customer)::DOUBLE AS value FROM (SELECT DISTINCT b FROM cyc)
  UNION ALL SELECT b, 'new_events', count(DISTINCT o_custkey)::DOUBLE FROM cyc GROUP BY 1
  UNION ALL SELECT * FROM (SELECT b, sid, sig FROM newest WHERE sig > 0 QUALIFY row_number() OVER (PARTITION BY b ORDER BY sig DESC, sid) <= 10))"""))
def cycle_digests(spark, d):
    """Three cycles of a streaming job: each finds files of later orders and scores entered by then."""
    base = scratch_path(spark, "cycles")
    filings = V.filings(spark, d).select("internal_company_id", "accepted_datetime")
    scores = V.predictions(spark, d, "region").select("sample_id", "internal_company_id", "entry_date", "predicted_signal")
    watched = V.table(spark, d, "customer").select("c_custkey")
    at = F.col("accepted_datetime")
    edges = [None, *_CYCLES, None]
    for low, high in zip(edges, edges[1:]):
        later = at >= V.eastern_mark(low) if low else F.lit(True)
        arrived = filings.where(later & (at < V.eastern_mark(high) if high else F.lit(True)))
        arrived.write.mode("append").parquet(f"{base}/arrived")
        entered = scores.where(F.col("entry_date") < F.lit(high).cast("date")) if high else scores
        stream = spark.readStream.schema(filings.schema).parquet(f"{base}/arrived")
        inc.digest_cycles(stream, "internal_company_id", "accepted_datetime", base,
                          lambda known=entered: inc.newest_scores(known, "internal_company_id", "entry_date"),
                          watched).awaitTermination()
    return spark.read.parquet(f"{base}/digest").select(big("batch").alias("cycle"), "item", num("value").alias("value"))
