"""The driver tables in the roles the operators expect.

Large tables are reduced to one row per key and date before any join, so a
hot supplier, customer or day collapses in the map-side combine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventide.functions import rolling as R
from eventide.functions import scalars as S
from eventide.operators import calendar as cal
from eventide.operators import (accounting, asof, candidates, events, feature_encoding,
                                market_features, scale_target, weights)
from eventide.operators import benchmarks as bench
from eventide.plans import artefacts, dataset, scoring
from eventide.session import materialize, scratch_path
from eventide.sources import tables

SMOOTH_DAYS = 60
TRAIN_END = "1998-12-31"
VALIDATION_END = "1999-12-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str) -> Column:
    return F.col(column).cast("timestamp").cast("date")


def eastern_wall(column: str) -> Column:
    """The instant at which New York clocks show the column's date and time."""
    return F.convert_timezone(F.lit("America/New_York"), F.current_timezone(),
                              F.col(column).cast("timestamp_ntz")).cast("timestamp")


def eastern_mark(text: str) -> Column:
    """The instant at which New York clocks show a literal date and time."""
    return F.convert_timezone(F.lit("America/New_York"), F.current_timezone(),
                              F.lit(text).cast("timestamp_ntz")).cast("timestamp")


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf_dir: str, name: str,
           build: Callable[[], DataFrame]) -> DataFrame:
    """Build a stage table once per session and source folder, then read it back.

    These are the tables a deployment keeps between steps (daily prices, event
    samples, predictions): written once, scanned with pruning by every later
    query instead of being derived from the raw tables again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        _STAGED[key] = materialize(build(), name, compression="zstd")
    return _STAGED[key]


_SPANS: dict[tuple[str, str], tuple[str, str]] = {}


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading calendar over the span of order and shipping dates.

    The span is two dates from one min/max aggregate, read once per session, so
    that the many uses of the calendar do not rescan the tables.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SPANS:
        orders = table(spark, sf_dir, "orders").select(_day("o_orderdate").alias("d"))
        lines = table(spark, sf_dir, "lineitem").select(_day("l_shipdate").alias("d"))
        row = (orders.unionByName(lines)
               .agg(F.min("d").cast("string").alias("lo"), F.max("d").cast("string").alias("hi"))
               .first())
        _SPANS[key] = (row.lo, row.hi)
    return staged(spark, sf_dir, "calendar", lambda: cal.calendar_between(spark, *_SPANS[key]))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events: the customer is the entity, urgent orders are annual forms."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("filing_event_id"),
        S.entity_id("o_custkey").alias("internal_company_id"),
        S.normalize_entity_key("o_custkey").alias("cik"),
        F.col("o_custkey").alias("custkey"),
        eastern_wall("o_orderdate").alias("accepted_datetime"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K").otherwise("10-Q")
        .alias("form_type"),
        F.last_day(F.add_months(_day("o_orderdate"), -1)).alias("report_period_end_date"),
        F.col("o_totalprice").alias("amount"))


def market_of(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """(nation key, market id, sector) with the market at region or nation level."""
    n = table(spark, sf_dir, "nation")
    key = "n_regionkey" if level == "region" else "n_nationkey"
    return n.select("n_nationkey", F.concat(F.lit("MKT"), F.col(key)).alias("market_id"),
                    F.col("n_regionkey").cast("string").alias("sector"))


def companies(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Entity to the market whose prices it trades at, and its sector."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return (c.join(market_of(spark, sf_dir, level), c.c_nationkey == F.col("n_nationkey"))
            .select(S.entity_id("c_custkey").alias("internal_company_id"), "market_id", "sector",
                    F.col("c_mktsegment").alias("segment")))


def prices(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    return staged(spark, sf_dir, f"prices_{level}", lambda: daily_prices(spark, sf_dir, level))


def daily_prices(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    """Daily price and volume per market: revenue over quantity of shipped lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", _day("l_shipdate").alias("date"),
                                                    "l_extendedprice", "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
    if level == "supplier":
        placed = placed.withColumn("market_id", F.concat(F.lit("MKT"), F.col("l_suppkey")))
    else:
        placed = placed.join(market_of(spark, sf_dir, level),
                             placed.s_nationkey == F.col("n_nationkey"))
    # The market is known before the sum, so its lines of a day meet inside each task.
    daily = placed.groupBy("market_id", "date").agg(F.sum("l_extendedprice").alias("_p"), F.sum("l_quantity").alias("_q"))
    # Nation prices average the last 60 days traded, which gives returns of a
    # realistic size; a single day's few lines would swing by half.
    recent = R.series("market_id", "date").rowsBetween(-(SMOOTH_DAYS - 1), 0)
    if level == "nation":
        price = F.sum("_p").over(recent) / F.sum("_q").over(recent)
    else:
        price = F.col("_p") / F.col("_q")
    return daily.select("market_id", "date", price.alias("adjusted_close"),
                        F.col("_q").alias("volume"))


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two index series: all lines, and lines shipped by the first region."""
    amounts = prices(spark, sf_dir, "region").select(
        "market_id", "date", (F.col("adjusted_close") * F.col("volume")).alias("_p"),
        F.col("volume").alias("_q"))

    def index(df: DataFrame, name: str) -> DataFrame:
        return (df.groupBy("date").agg((F.sum("_p") / F.sum("_q")).alias("adjusted_close"))
                .select(F.lit(name).alias("symbol"), "date", "adjusted_close"))

    return index(amounts, "SPY").unionByName(
        index(amounts.where(F.col("market_id") == "MKT0"), "QQQ"))


def placed_filings(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    return filings(spark, sf_dir).join(companies(spark, sf_dir, level), "internal_company_id")


def event_samples(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Event samples of the driver tables, staged."""
    def build() -> DataFrame:
        return events.build_event_samples(
            placed_filings(spark, sf_dir, level), prices(spark, sf_dir, level),
            calendar(spark, sf_dir), train_end=TRAIN_END, validation_end=VALIDATION_END,
            benchmarks=benchmarks(spark, sf_dir), price_key="market_id")[0]
    return staged(spark, sf_dir, f"samples_{level}", build)


def scaled_samples(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Event samples with their ex-ante scale and tanh target, staged."""
    def build() -> DataFrame:
        scaled = scale_target.with_ex_ante_scale(
            event_samples(spark, sf_dir, level), prices(spark, sf_dir, level), "market_id",
            stage=lambda df: materialize(df, "daily-vol"))
        return scale_target.with_target(scaled)
    return staged(spark, sf_dir, f"scaled_{level}", build)


def facts(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Shipped lines as reported values of an (entity, concept, period)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
        "l_extendedprice", _day("l_shipdate").alias("ship"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    joined = li.join(o, li.l_orderkey == o.o_orderkey)
    if coarse:
        concept = F.lit("ALL")
    else:
        part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
        joined = joined.join(part, joined.l_partkey == part.p_partkey)
        concept = F.col("p_brand")
    return joined.select(
        S.entity_id("o_custkey").alias("internal_company_id"),
        F.col("l_returnflag").alias("taxonomy"), concept.alias("concept_name"),
        F.col("l_linestatus").alias("unit"), F.col("l_extendedprice").alias("value"),
        F.last_day("ship").alias("period_end_date"),
        F.concat(F.lit("Q"), F.quarter("ship").cast("string")).alias("fiscal_period"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "10-K")
        .when(F.col("o_orderpriority") == "5-LOW", "8-K").otherwise("10-Q").alias("form_type"),
        F.col("ship").alias("accepted_date"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("fact_id"))


MIN_COMPANIES = 20


def train_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).where(F.col("split") == "train")


def feature_map(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    def build() -> DataFrame:
        train = train_samples(spark, sf_dir)
        visible = feature_encoding.visible_facts(facts(spark, sf_dir, coarse), train)
        return feature_encoding.fit_feature_map(
            visible, min_companies=MIN_COMPANIES, n_samples=train.agg(F.count(F.lit(1))).scalar())
    return staged(spark, sf_dir, f"feature_map_{coarse}", build)


def cells(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Point-in-time fact cells of every sample, staged."""
    def build() -> DataFrame:
        mapped = feature_encoding.map_facts(facts(spark, sf_dir, coarse),
                                            feature_map(spark, sf_dir, coarse))
        # The splits of a sample id travel with it; joined to the cells they would move every cell again.
        same = Window.partitionBy("internal_company_id", "sample_id")
        samples = event_samples(spark, sf_dir).repartition("internal_company_id").select(
            "sample_id", "internal_company_id", "accepted_datetime", "entry_date",
            F.collect_list("split").over(same).alias("_splits"))
        found = feature_encoding.fact_cells(samples, feature_encoding.fact_versions(mapped), keep=["_splits"])
        return found.withColumn("split", F.explode("_splits")).drop("_splits")
    return staged(spark, sf_dir, f"cells_{coarse}", build)


def grid(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """Forward-filled daily prices of every market on every trading day, staged."""
    return staged(spark, sf_dir, f"grid_{level}", lambda: asof.filled_grid(
        prices(spark, sf_dir, level), cal.trading_days(calendar(spark, sf_dir)), "market_id",
        ["adjusted_close", "volume"]))


def predictions(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """A closed-form score of each sample with the columns models would give, staged."""
    def build() -> DataFrame:
        s = scaled_samples(spark, sf_dir, level)
        mean = s.agg(F.avg("amount")).scalar()
        signal = F.tanh(F.col("amount") / mean - 1.0)
        return (s.withColumn("predicted_signal", signal)
                .withColumn("probability_positive", F.lit(0.5) + F.col("predicted_signal") / 4.0)
                .withColumn("predicted_signal_std",
                            F.lit(0.1) + F.abs("predicted_signal") / 5.0)
                .select("sample_id", "internal_company_id", "market_id", "sector", "segment",
                        "entry_date", "exit_date", "split", "predicted_signal",
                        "probability_positive", "predicted_signal_std", "ex_ante_scale",
                        "target_normalized_signal", "raw_log_return", "spy_log_return", "amount"))
    return staged(spark, sf_dir, f"predictions_{level}", build)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.trading_days(calendar(spark, sf_dir))


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as the intervals of trading days on which each is its entity's latest, staged."""
    return staged(spark, sf_dir, "pieces", lambda: candidates.active_pieces(
        predictions(spark, sf_dir), calendar(spark, sf_dir), days(spark, sf_dir)))


def risk_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volatility of every market known before each trading day, staged."""
    return staged(spark, sf_dir, "risk_vol", lambda: candidates.risk_vol_by_day(
        prices(spark, sf_dir, "nation"), calendar(spark, sf_dir), days(spark, sf_dir), "market_id"))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per trading day and active name with the day's risk, for rules that weigh every name."""
    expanded = pieces(spark, sf_dir).withColumn("seq", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return candidates.with_dates(candidates.with_risk(expanded, risk_vol(spark, sf_dir), "market_id"), days(spark, sf_dir))


RULES = candidates.PortfolioRules()


def selected(spark: SparkSession, sf_dir: str, rules: candidates.PortfolioRules) -> DataFrame:
    return candidates.candidates_by_day(pieces(spark, sf_dir), risk_vol(spark, sf_dir), "market_id", days(spark, sf_dir), rules)


def decayed_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's candidates by signal decayed with its age."""
    return candidates.decayed_candidates_by_day(pieces(spark, sf_dir), risk_vol(spark, sf_dir), "market_id",
                                                calendar(spark, sf_dir), days(spark, sf_dir), RULES)


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's candidates by signal, staged."""
    return staged(spark, sf_dir, "picks",
                  lambda: selected(spark, sf_dir, RULES))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal over volatility weights of every trading day, staged."""
    return staged(spark, sf_dir, "targets", lambda: weights.inverse_vol_weights(
        picks(spark, sf_dir), RULES))


def portfolio(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Daily returns, holdings and trades of the staged target weights, from one staged drift."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PORTFOLIOS:
        _PORTFOLIOS[key] = accounting.account(
            targets(spark, sf_dir), predictions(spark, sf_dir), grid(spark, sf_dir),
            days(spark, sf_dir), key="market_id", stage=materialize)
    return _PORTFOLIOS[key]


_PORTFOLIOS: dict[tuple[str, str], dict[str, DataFrame]] = {}


def entity_markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return companies(spark, sf_dir, "nation")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "grid_state",
                  lambda: bench.grid_state(grid(spark, sf_dir), "market_id"))


def all_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(portfolio, date, ret, turnover) of the strategy and every benchmark, staged."""
    def build() -> DataFrame:
        s = state(spark, sf_dir)
        names = prices(spark, sf_dir, "nation").agg(F.countDistinct("market_id")).scalar()
        dd = days(spark, sf_dir).select("date")
        daily = portfolio(spark, sf_dir)["daily"]
        counts = bench.active_counts(predictions(spark, sf_dir), calendar(spark, sf_dir),
                                     days(spark, sf_dir), "market_id")
        running = pieces(spark, sf_dir).select("internal_company_id", "market_id", "predicted_signal", "_a", "_b")
        drawn = staged(spark, sf_dir, "random_names", lambda: bench.random_names(
            running, days(spark, sf_dir), stage=lambda df: materialize(df, "random-names")))
        strong = bench.strongest_signals(running, days(spark, sf_dir))
        wide = [bench.universe_returns(s, names),
                bench.active_returns(counts, s, "market_id").withColumnRenamed(
                    "inverse_vol_active_after_cost", "inverse_vol_active_10bps"),
                bench.random_returns(drawn, s, "market_id"),
                bench.shuffled_returns(strong, drawn, s, "market_id")]
        index = (bench.index_returns(benchmarks(spark, sf_dir)).join(dd, "date")
                 .select(F.lower("symbol").alias("portfolio"), "date", "ret",
                         F.lit(0.0).alias("turnover")))
        rows = index.unionByName(daily.select(F.lit("strategy").alias("portfolio"), "date",
                                              F.col("net_return").alias("ret"), "turnover"))
        for w in wide:
            columns = [c for c in w.columns if c != "date"]
            filled = dd.join(w, "date", "left").na.fill(0.0, columns)
            rows = rows.unionByName(filled.unpivot("date", columns, "portfolio", "ret")
                                    .withColumn("turnover", F.lit(0.0)))
        return rows
    return staged(spark, sf_dir, "all_returns", build)


HELD_BUCKETS = [7, 8, 9]


def held_entities(transfer: bool) -> Column:
    """Entities kept out of every statistic in the transfer setting."""
    return S.hash_bucket("internal_company_id", 10).isin(HELD_BUCKETS) if transfer else F.lit(False)


def encoder(spark: SparkSession, sf_dir: str, transfer: bool = False) -> dict[str, DataFrame]:
    """The encoder fitted on the training rows (of the entities not held out), saved and loaded."""
    key = (spark.sparkContext.applicationId, sf_dir, transfer)
    if key not in _ENCODERS:
        train = train_samples(spark, sf_dir).where(~held_entities(transfer))
        own = facts(spark, sf_dir).where(~held_entities(transfer))
        path = scratch_path(spark, "encoder")
        tables.save_encoder(feature_encoding.fit_encoder(
            train, own, min_companies=MIN_COMPANIES, stage=lambda df: materialize(df, "encoder-cells")), path)
        _ENCODERS[key] = path
    return tables.load_encoder(spark, _ENCODERS[key])


_ENCODERS: dict[tuple[str, str, bool], str] = {}


def model_matrix(spark: SparkSession, sf_dir: str, transfer: bool = False) -> DataFrame:
    """Labelled sparse vectors of every sample over all ids, periods and blocks, staged."""
    key = (spark.sparkContext.applicationId, sf_dir, transfer)
    if key not in _MATRICES:
        fit_on = (F.col("split") == "train") & ~held_entities(transfer)
        samples = scaled_samples(spark, sf_dir)
        trailing = dataset.trailing_features(
            samples, prices(spark, sf_dir), "market_id", fit_on,
            panel=market_features.market_panel(grid(spark, sf_dir), "market_id"),
            stage=lambda df: materialize(df, "trailing"))
        rows = dataset.encoded_matrix(samples, facts(spark, sf_dir), encoder(spark, sf_dir, transfer), trailing, fit_on,
                                      MATRIX_KEYS, stage=lambda df: materialize(df, "matrix-cells"))
        path = scratch_path(spark, "matrix")
        rows.write.parquet(path)
        _MATRICES[key] = path
    return feature_encoding.read_vectors(spark, _MATRICES[key])


_MATRICES: dict[tuple[str, str, bool], str] = {}
LIVE_DAY = "2000-06-03"


def model_inputs(spark: SparkSession, sf_dir: str) -> artefacts.Inputs:
    return artefacts.Inputs(facts(spark, sf_dir), prices(spark, sf_dir), "market_id",
                            market_features.market_panel(grid(spark, sf_dir), "market_id"))


def saved_models(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the encoder and ridge model fitted on the training rows, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        path = scratch_path(spark, "models")
        artefacts.fit(scaled_samples(spark, sf_dir), model_inputs(spark, sf_dir), path, min_companies=MIN_COMPANIES)
        _SAVED[key] = path
    return _SAVED[key]


_SAVED: dict[tuple[str, str], str] = {}


def live_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event each entity had by the live day, with its ex-ante scale, staged."""
    def build() -> DataFrame:
        closed = event_samples(spark, sf_dir).where(F.col("exit_date") < F.lit(LIVE_DAY).cast("date"))
        return scoring.live_with_scale(placed_filings(spark, sf_dir), closed, prices(spark, sf_dir),
                                       calendar(spark, sf_dir), "market_id", LIVE_DAY)
    return staged(spark, sf_dir, "live_samples", build)


MATRIX_KEYS = ["sample_id", "internal_company_id", "split", "entry_date", "exit_date",
               "ex_ante_scale", "target_normalized_signal", "raw_log_return", "holding_days"]
