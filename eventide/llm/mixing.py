"""Mixing sources by temperature: an exponent on token shares, found by bisection.

Shares raised to an exponent below one favour small sources. The exponent is the
largest whose mixture still reaches the wanted entropy, raised again as far as no
source is repeated more often than allowed. Each source then gets its part of the
token budget as whole passes over its documents and one partial pass, every pass a
fresh permutation of blocks of documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from eventide.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
GRID = 32  # exponents tried at once in a round of the bisection
ROUNDS = 7  # 32**-7 is below 3e-11
COARSE = 1024  # ranges of a block order that are summed first


@dataclass(frozen=True)
class Target:
    """Wanted entropy as a share of the largest possible, and the most passes over a source."""

    entropy: float = 0.97
    repeats: float = 4.0
    budget: float = 1.0  # tokens drawn, as a multiple of the tokens there are
    block_docs: int = 256
    seed: int = 17


def weigh(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Id, source and number of words of each document; a null text has none."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"))


def fit_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent, from a table of one row per source with ``tokens``.

    Entropy falls and repetition of small sources falls as the exponent grows.
    A round measures a grid of exponents in one aggregate over the sources and
    keeps the interval in which the condition changes.
    """
    live = sources.where("tokens > 0")
    total, n = live.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(total)))

    def search(holds_from: bool, test) -> float:
        """Smallest exponent from which ``test`` holds, or the largest up to which it holds."""
        low, high = 0.0, 1.0
        for _ in range(ROUNDS):
            grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
            sums = live.agg(*[f.alias(f"{name}{k}") for k, x in enumerate(grid) for name, f in (
                ("z", F.sum(F.exp(log_share * x))), ("e", F.sum(F.exp(log_share * x) * log_share)),
                ("r", F.max(F.exp(log_share * (x - 1.0)))))]).first()
            good = [test(x, sums[f"z{k}"], sums[f"e{k}"], sums[f"r{k}"]) for k, x in enumerate(grid)]
            if holds_from:
                if good[0]:
                    return low
                at = next((k for k, g in enumerate(good) if g), GRID)
            else:
                if good[-1]:
                    return high
                at = next((k for k, g in enumerate(good) if not g), GRID)
                if at == 0:
                    return low
            low, high = grid[at - 1], grid[at]
        return high if holds_from else low

    import math
    wanted = target.entropy * math.log(n)
    by_entropy = search(False, lambda x, z, e, r: math.log(z) - x * e / z >= wanted - 1e-12)
    by_repeats = search(True, lambda x, z, e, r: target.budget * r / z <= target.repeats)
    return max(by_entropy, by_repeats)


def _key() -> Column:
    """A source as a string key that keeps null apart from every name."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))


def passes(sized: DataFrame, target: Target) -> tuple[DataFrame, float]:
    """Per source its weight, whole passes, and tokens of the partial pass; and the exponent."""
    sources = materialize(sized.groupBy(_key().alias("key")).agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sources")
    exponent = fit_exponent(sources, target)
    total = float(sources.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(max(total, 1.0)), F.lit(exponent))).otherwise(0.0)
    norm = sources.agg(F.sum(raised)).first()[0] or 1.0
    budget = F.col("weight") * F.lit(target.budget * total)
    return (sources.withColumn("weight", raised / F.lit(norm))
            .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens") + 1e-9)).otherwise(0).cast("long"))
            .withColumn("rest", F.greatest(budget - F.col("whole") * F.col("tokens"), F.lit(0.0)))
            .withColumn("blocks", F.ceil(F.col("docs") / target.block_docs).cast("long"))), exponent


def mix_sources(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id",
                source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per drawn copy: doc_id, source, n_tokens, epoch, weight, block_order, doc_order.

    Sorting a source by (epoch, block_order, doc_order) reads its passes one after
    the other. The partial pass takes documents in that order while the sum of their
    tokens stays within the budget, so a source is at most one document short of it.
    Sums run over ranges of blocks, then blocks, then the documents of the one block
    in which the budget ends, so a source of any size stays spread out.

    A null source is a source of its own. A source without tokens gets no copies.
    Documents without tokens are drawn with their source. Rows that repeat an id stay
    rows of their own; null ids share one place in the order. An empty table gives
    no rows.
    """
    sized = materialize(weigh(docs, id_col, source_col, text_col), "weighed").withColumn("key", _key())
    plan, _ = passes(sized.drop("key"), target)
    plan = materialize(plan, "source-passes")
    seed = F.lit(target.seed)
    placed = sized.join(plan.select("key", "weight", "whole", "rest", "blocks"), "key").withColumn(
        "block", F.pmod(F.xxhash64(seed, F.col("doc_id")), F.col("blocks")))
    order = {"block_order": F.xxhash64(seed, F.col("epoch"), F.col("key"), F.col("block")),
             "doc_order": F.xxhash64(seed, F.col("epoch"), F.col("doc_id"), F.col("n_tokens"))}

    last = placed.where("rest > 0").withColumn("epoch", F.col("whole")).withColumns(order)
    blocks = materialize(last.groupBy("key", "block", "block_order").agg(
        F.sum("n_tokens").alias("tokens"), F.first("rest").alias("rest")), "mix-blocks").withColumn(
        "range", F.floor((F.shiftrightunsigned("block_order", 1)) / F.lit(float(2**63 // COARSE))))
    ranges = blocks.groupBy("key", "range").agg(F.sum("tokens").alias("in_range"))
    before = ranges.withColumn("before_range", F.coalesce(F.sum("in_range").over(
        Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by_block = Window.partitionBy("key", "range").orderBy("block_order", "block").rowsBetween(Window.unboundedPreceding, -1)
    cut = (blocks.join(before, ["key", "range"])
           .withColumn("before", F.col("before_range") + F.coalesce(F.sum("tokens").over(by_block), F.lit(0)))
           .where("before < rest").select("key", "block", "before", (F.col("before") + F.col("tokens") <= F.col("rest")).alias("all_in")))
    drawn = last.join(cut, ["key", "block"])
    by_doc = Window.partitionBy("key", "block").orderBy("doc_order", "doc_id", "n_tokens")
    edge = drawn.where("NOT all_in").withColumn("upto", F.col("before") + F.sum("n_tokens").over(by_doc)).where("upto <= rest")
    columns = ["doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "weight", "block_order", "doc_order"]
    full = (placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)))
            .withColumns(order).select(*columns))
    return full.union(drawn.where("all_in").select(*columns)).union(edge.select(*columns))
