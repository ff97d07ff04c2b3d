"""Data-quality gates: each is one aggregate giving the number of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions import scalars as S

# Words that must not appear in model column names.
FORBIDDEN_WORDS = ["revenue", "income", "asset", "liability", "cash", "debt", "equity", "eps",
                   "margin", "roe", "roa", "earnings"]


class GateFailure(Exception):
    """A gate found violations."""


def _count(df: DataFrame, gate: str, bad: Column) -> DataFrame:
    return df.agg(F.count_if(bad).alias("violations")).select(
        F.lit(gate).alias("gate"), "violations")


def date_ordering(samples: DataFrame) -> DataFrame:
    ok = ((F.col("entry_date") > F.col("report_event_date"))
          & (F.col("exit_date") < F.col("next_report_event_date"))
          & (F.col("entry_date") < F.col("exit_date")))
    return _count(samples, "date_ordering", ~F.coalesce(ok, F.lit(False)))


def in_range(df: DataFrame, column: str, gate: str, tolerance: float = 0.0) -> DataFrame:
    return _count(df, gate, F.abs(column) > 1.0 + tolerance)


def anonymous_columns(df: DataFrame, allowed_prefix: str = "meta_") -> DataFrame:
    """Model columns must be opaque; only names are inspected."""
    named = [c for c in df.columns if not c.startswith(allowed_prefix)
             and any(w in c.lower() for w in FORBIDDEN_WORDS)]
    return df.agg(F.lit(len(named)).cast("bigint").alias("violations")).select(
        F.lit("anonymous_columns").alias("gate"), "violations")


def portfolio_weights(weights: DataFrame, max_weight: float, leverage: float = 1.0,
                      day: str = "as_of") -> DataFrame:
    per = weights.groupBy(day).agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"),
                                   F.sum("weight").alias("total"))
    bad = ((F.col("lo") < -1e-9) | (F.col("hi") > max_weight + 1e-9)
           | (F.col("total") > leverage + 1e-9))
    return _count(per, "portfolio_weights", bad)


def accounting(daily: DataFrame) -> DataFrame:
    gap = F.abs(F.col("net_return") - (F.col("gross_return") - F.col("transaction_cost_return")))
    return _count(daily, "accounting", (F.col("portfolio_value") <= 0) | (gap > 1e-9))


def no_future_facts(samples: DataFrame, cells: DataFrame) -> DataFrame:
    """No fact used by a sample may be accepted after the sample's own event."""
    seen = cells.select("sample_id", "accepted_date").join(
        samples.select("sample_id", S.event_day(samples).alias("_day")), "sample_id")
    return _count(seen, "no_future_facts", F.col("accepted_date") > F.col("_day"))


def unique_key(df: DataFrame, keys: list[str], gate: str) -> DataFrame:
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _count(per, gate, F.col("n") > 1)


def price_quality(prices: DataFrame, key: str) -> DataFrame:
    """Per series: rows, duplicate dates, non-positive closes and negative volumes."""
    daily = prices.groupBy(key, "date").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("adjusted_close") <= 0).alias("p"),
        F.count_if(F.col("volume") < 0).alias("v"))
    return daily.groupBy(key).agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("duplicate_dates"),
        F.sum("p").alias("nonpositive_closes"), F.sum("v").alias("negative_volumes"))


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(gate, violations) of any number of row rules in one pass."""
    one = df.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    return one.unpivot([], list(rules), "gate", "violations")


def all_gates(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("violations") == 0)


def require(gates: DataFrame) -> None:
    """Raise on any failed gate; the table has one row per gate."""
    failed = [f"{r.gate} ({r.violations})" for r in gates.where(~F.col("passed")).collect()]
    if failed:
        raise GateFailure("; ".join(failed))
