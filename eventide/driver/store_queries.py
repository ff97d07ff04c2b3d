"""Sinks read back, positional reads and joins that other queries do not show."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventide.driver import sql as Q
from eventide.driver import views as V
from eventide.driver.registry import big, day, num, query
from eventide.driver.sql import r
from eventide.operators import universe
from eventide.plans import learning
from eventide.session import scratch_path
from eventide.sources import documents as docs
from eventide.sources import tables


@query("partitioned_table", f"""
SELECT o_orderpriority AS priority, count(*)::BIGINT AS rows, {r('sum(o_totalprice)', 2)} AS total FROM orders GROUP BY 1""")
def partitioned_table(spark, d):
    """A table written in partitions, clustered, and read back by column names."""
    path = scratch_path(spark, "orders")
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    tables.write_table(o, path, partition_by=["o_orderpriority"], cluster_by=["o_custkey"])
    back = tables.read_table(spark, path, ["o_orderpriority", "o_totalprice"])
    return back.groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("rows"), num(F.sum("o_totalprice"), 2).alias("total"))


@query("report_sinks", f"""
SELECT c_mktsegment AS segment, count(*)::BIGINT AS customers, {r('avg(c_acctbal)', 4)} AS balance FROM customer GROUP BY 1""")
def report_sinks(spark, d):
    """A report through the CSV and JSON sinks; both must hold the same rows."""
    path = scratch_path(spark, "report")
    report = V.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.avg("c_acctbal").alias("balance"))
    tables.write_report_csv(report, f"{path}/csv")
    tables.write_report_json(report, f"{path}/json")
    schema = "segment string, customers long, balance double"
    from_csv = spark.read.option("header", True).schema(schema).csv(f"{path}/csv")
    from_json = spark.read.schema(schema).json(f"{path}/json")
    both = from_csv.join(from_json.select("segment", F.col("customers").alias("again")), "segment").where("customers = again")
    return both.select("segment", "customers", num("balance", 4).alias("balance"))


@query("run_registry", f"""
SELECT CASE WHEN o_orderdate < DATE '1999-01-01' THEN 'to_1998' ELSE 'from_1999' END AS run, o_orderpriority AS priority,
  count(*)::BIGINT AS orders, {r('max(o_totalprice)', 4)} AS largest FROM orders GROUP BY ALL""")
def run_registry(spark, d):
    """Two runs over orders, each appended to the registry as its summary by priority."""
    path = scratch_path(spark, "runs")
    orders = V.table(spark, d, "orders")
    early = F.col("o_orderdate").cast("date") < F.lit("1999-01-01").cast("date")
    for run, rows in (("to_1998", early), ("from_1999", ~early)):
        summary = orders.where(rows).groupBy(F.col("o_orderpriority").alias("priority")).agg(
            F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"))
        tables.append_run(summary.withColumn("run", F.lit(run)), path)
    return spark.read.parquet(path).select("run", "priority", big("orders").alias("orders"), num("largest", 4).alias("largest"))


@query("counted_write", """
SELECT count(*)::BIGINT AS written, count(*)::BIGINT AS stored FROM events""")
def counted_write(spark, d):
    """The row count observed during a write, beside the count of what was stored."""
    path = scratch_path(spark, "counted")
    n = tables.write_counted(V.table(spark, d, "events"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("stored")).select(F.lit(n).cast("bigint").alias("written"), "stored")


@query("positional_slice", """
SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 500 OFFSET 300""")
def positional_slice(spark, d):
    return universe.positional_slice(V.table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 300, 800).select("o_orderkey")


@query("positional_first", """
SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25""")
def positional_first(spark, d):
    c = V.table(spark, d, "customer").withColumn("rank_by", -F.col("c_acctbal"))
    return tables.positional_first(c, ["rank_by", "c_custkey"], 25).select("c_custkey")


@query("price_entities", Q.with_("co_region px_region", f"""
SELECT p.mkt AS ticker, c.ent AS internal_company_id, p.date::VARCHAR AS date, {r('p.px')} AS adjusted_close
FROM px_region p LEFT JOIN (SELECT mkt, min(ent) AS ent FROM co_region WHERE mkt <> 'MKT0' GROUP BY 1) c ON c.mkt = p.mkt"""))
def price_entities(spark, d):
    """Prices with the entity of their ticker; a ticker without one keeps a null."""
    firsts = (V.companies(spark, d).where(F.col("market_id") != "MKT0").groupBy(F.col("market_id").alias("ticker"))
              .agg(F.min("internal_company_id").alias("internal_company_id")))
    p = V.prices(spark, d).withColumnRenamed("market_id", "ticker_at_date")
    return tables.with_entity(p, firsts).select(F.col("ticker_at_date").alias("ticker"), "internal_company_id",
                                                day("date").alias("date"), num("adjusted_close").alias("adjusted_close"))


@query("predictions_in_context", Q.with_(Q.scaled(), f"""
SELECT sid AS sample_id, ent AS internal_company_id, en::VARCHAR AS entry_date, {r('ret')} AS raw_log_return,
  {r('scale')} AS ex_ante_scale FROM scl_region"""))
def predictions_in_context(spark, d):
    """Bare predictions joined with the sample columns that later steps need."""
    samples = V.scaled_samples(spark, d)
    bare = samples.select("sample_id", F.lit(0.0).alias("predicted_signal"))
    return learning.attach_context(bare, samples).select(
        "sample_id", "internal_company_id", day("entry_date").alias("entry_date"), num("raw_log_return").alias("raw_log_return"),
        num("ex_ante_scale").alias("ex_ante_scale"))


@query("first_order_of_customer", """
SELECT o_custkey, o_orderkey, o_orderpriority FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""")
def first_order_of_customer(spark, d):
    return docs.first_per_key(V.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select(
        "o_custkey", "o_orderkey", "o_orderpriority")


@query("constituents", """
SELECT replace(replace(c_name, '#', '.'), '.', '-') AS ticker_yf, lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_mktsegment AS sector FROM customer""")
def constituents(spark, d):
    """A constituent table in the public column names, normalised."""
    c = V.table(spark, d, "customer")
    raw = c.select(F.translate("c_name", "#", ".").alias("Symbol"), F.col("c_mktsegment").alias("GICS Sector"),
                   F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("CIK"))
    return docs.constituent_list(raw).select("ticker_yf", "cik", "sector")
