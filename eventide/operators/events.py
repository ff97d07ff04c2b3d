"""Event samples: pair each event with its successor and price both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.functions import rolling as R
from eventide.functions import scalars as S
from eventide.operators import calendar as cal

ANNUAL_FORM, QUARTERLY_FORM = "10-K", "10-Q"

# The exclusion vocabulary that downstream reports rely on.
DUPLICATE = "duplicate_event_same_date"
CALENDAR_EDGE = "insufficient_price_history"
ENTRY_AFTER_EXIT = "entry_after_exit"
NO_ENTRY_PRICE = "missing_entry_price"
NO_EXIT_PRICE = "missing_exit_price"
NO_NEXT_EVENT = "missing_next_event"

ENTITY = "internal_company_id"


def dedupe_same_day(filings: DataFrame) -> DataFrame:
    """One event per entity and day: annual form first, then the latest accepted.

    An aggregate rather than a ranking window: duplicates of a hot entity and
    day are reduced before the shuffle. The smallest event id breaks ties.
    """
    dated = filings.withColumn("event_date", S.event_day(filings))
    rest = [c for c in dated.columns if c not in (ENTITY, "event_date", "filing_event_id")]
    order = F.struct(F.when(F.col("form_type") == ANNUAL_FORM, 0).otherwise(1).alias("a"),
                     (-F.unix_micros("accepted_datetime")).alias("b"),
                     F.col("filing_event_id"), F.struct(*rest).alias("r"))
    return (dated.groupBy(ENTITY, "event_date").agg(F.min(order).alias("_best"))
            .select(ENTITY, "event_date", F.col("_best.filing_event_id").alias("filing_event_id"),
                    "_best.r.*"))


def dropped_duplicates(filings: DataFrame, kept: DataFrame) -> DataFrame:
    return (filings.join(kept.select("filing_event_id"), "filing_event_id", "left_anti")
            .select(ENTITY, "filing_event_id", F.lit(DUPLICATE).alias("exclusion_reason")))


def split_of(date: str, train_end: str, validation_end: str):
    d = F.col(date)
    return (F.when(d <= F.lit(train_end).cast("date"), "train")
            .when(d <= F.lit(validation_end).cast("date"), "validation").otherwise("test"))


def classify_events(kept: DataFrame, prices: DataFrame, calendar: DataFrame,
                    price_key: str = ENTITY) -> DataFrame:
    """Every kept event with its successor, entry, exit, prices and exclusion reason."""
    w = R.series(ENTITY, "event_date")
    paired = (kept.withColumn("next_filing_event_id", F.lead("filing_event_id").over(w))
              .withColumn("next_report_event_date", F.lead("event_date").over(w)))
    dated = cal.with_neighbour(paired, calendar, "event_date", "entry_date", "next")
    dated = cal.with_neighbour(dated, calendar, "next_report_event_date", "exit_date", "previous")
    priced = dated
    for end in ("entry", "exit"):
        quote = prices.select(price_key, F.col("date").alias(f"{end}_date"),
                              F.col("adjusted_close").alias(f"{end}_price"))
        priced = priced.join(quote, [price_key, f"{end}_date"], "left")
    usable = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    reason = (F.when(F.col("next_filing_event_id").isNull(), NO_NEXT_EVENT)
              .when(F.col("entry_date").isNull() | F.col("exit_date").isNull(), CALENDAR_EDGE)
              .when(F.col("entry_date") >= F.col("exit_date"), ENTRY_AFTER_EXIT)
              .when(~usable("entry_price"), NO_ENTRY_PRICE)
              .when(~usable("exit_price"), NO_EXIT_PRICE))
    return priced.withColumn("exclusion_reason", reason)


def sample_id(suffix: str = ""):
    base = S.hash_id("SAMPLE_", [ENTITY, "filing_event_id"], 16)
    return F.concat(base, F.lit(suffix)) if suffix else base


def build_event_samples(filings: DataFrame, prices: DataFrame, calendar: DataFrame, *,
                        train_end: str, validation_end: str,
                        benchmarks: DataFrame | None = None, price_key: str = ENTITY,
                        ) -> tuple[DataFrame, DataFrame]:
    """(samples, excluded): one sample per event with a usable successor.

    ``price_key`` names the column that links an event to the price table; it
    is the entity itself unless entities share a price series.
    """
    kept = dedupe_same_day(filings)
    staged = classify_events(kept, prices, calendar, price_key)
    samples = (staged.where(F.col("exclusion_reason").isNull())
               .withColumn("sample_id", sample_id())
               .withColumn("raw_log_return", S.log_return("exit_price", "entry_price"))
               .withColumn("raw_simple_return", S.simple_return("exit_price", "entry_price"))
               .withColumn("eligible_for_training", F.lit(True))
               .withColumn("eligible_for_backtest", F.lit(True))
               .withColumn("split", split_of("entry_date", train_end, validation_end))
               .withColumnRenamed("event_date", "report_event_date"))
    samples = cal.with_trading_days_between(samples, calendar, "entry_date", "exit_date",
                                            "holding_days")
    if benchmarks is not None:
        samples = with_benchmark_returns(samples, benchmarks,
                                         {"spy_log_return": "SPY", "qqq_log_return": "QQQ"})
    excluded = (staged.where(F.col("exclusion_reason").isNotNull())
                .select(ENTITY, "filing_event_id", "exclusion_reason")
                .unionByName(dropped_duplicates(filings, kept)))
    return samples, excluded


def with_benchmark_returns(samples: DataFrame, benchmarks: DataFrame,
                           columns: dict[str, str]) -> DataFrame:
    """Log return of each benchmark symbol from entry to exit, null when unpriced.

    The symbols become columns of one row per date, so two joins serve all.
    """
    quotes = benchmarks.groupBy("date").agg(*[
        F.max(F.when(F.col("symbol") == s, F.col("adjusted_close"))).alias(f"_{c}")
        for c, s in columns.items()])
    out = samples
    for end in ("entry", "exit"):
        out = out.join(quotes.select(F.col("date").alias(f"{end}_date"),
                                     *[F.col(f"_{c}").alias(f"_{end}_{c}") for c in columns]),
                       f"{end}_date", "left")
    for c in columns:
        out = out.withColumn(c, S.log_return(f"_exit_{c}", f"_entry_{c}"))
    return out.drop(*[f"_{end}_{c}" for end in ("entry", "exit") for c in columns])


def _forecast_rows(anchored: DataFrame, prices: DataFrame, calendar: DataFrame, price_key: str,
                   holding: int, suffix: str, reason: str, split: str) -> DataFrame:
    """Shared tail of open and live samples: price the entry, project the exit."""
    days = cal.trading_days(calendar)
    last = days.agg(F.max("seq")).scalar()
    entry_seq = days.select(F.col("date").alias("entry_date"), F.col("seq").alias("_seq"))
    exit_day = days.select(F.col("date").alias("exit_date"), F.col("seq").alias("_exit_seq"))
    quote = prices.select(price_key, F.col("date").alias("entry_date"),
                          F.col("adjusted_close").alias("entry_price"))
    return (anchored.join(quote, [price_key, "entry_date"])
            .where(F.col("entry_price") > 0)
            .join(F.broadcast(entry_seq), "entry_date")
            .withColumn("_exit_seq", F.least(F.col("_seq") + holding, last))
            .join(F.broadcast(exit_day), "_exit_seq")
            .drop("_seq", "_exit_seq")
            .withColumn("sample_id", sample_id(suffix))
            .withColumn("exclusion_reason", F.lit(reason))
            .withColumn("split", F.lit(split))
            .withColumn("eligible_for_training", F.lit(False))
            .withColumn("eligible_for_backtest", F.lit(False))
            .withColumn("holding_days", F.lit(holding))
            .withColumnRenamed("event_date", "report_event_date"))


def _latest(kept: DataFrame) -> DataFrame:
    rest = [c for c in kept.columns if c != ENTITY]
    return (kept.groupBy(ENTITY).agg(F.max_by(F.struct(*rest), "event_date").alias("_e"))
            .select(ENTITY, "_e.*"))


def build_open_samples(filings: DataFrame, prices: DataFrame, calendar: DataFrame, *,
                       price_key: str = ENTITY, holding: int = 60) -> DataFrame:
    """Latest event of each entity, entered the next trading day, exit projected."""
    latest = _latest(dedupe_same_day(filings))
    entered = cal.with_neighbour(latest, calendar, "event_date", "entry_date", "next")
    return _forecast_rows(entered, prices, calendar, price_key, holding, "_OPEN",
                          "open_position_forecast", "open")


def build_live_samples(filings: DataFrame, prices: DataFrame, calendar: DataFrame, *,
                       as_of: str | None = None, price_key: str = ENTITY,
                       holding: int = 60) -> DataFrame:
    """Latest event known at the anchor day, entered at the anchor.

    The anchor is the first trading day at or after ``as_of`` (default: the
    last price date), or ``as_of`` itself past the calendar's end.
    """
    day = (F.lit(as_of).cast("date") if as_of else prices.agg(F.max("date")).scalar())
    candidates = (calendar.where(F.col("is_trading_day") & (F.col("date") >= day))
                  .agg(F.min("date")).scalar())
    kept = dedupe_same_day(filings).withColumn("entry_date", F.coalesce(candidates, day))
    known = kept.where(F.col("event_date") <= F.col("entry_date"))
    return _forecast_rows(_latest(known), prices, calendar, price_key, holding, "_LIVE",
                          "live_prediction_anchor", "live")
