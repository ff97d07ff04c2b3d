"""The best rows of every day among rows that hold for an interval of days.

An interval of day numbers is a few dyadic blocks (days whose numbers agree but for their last
binary digits), at most two of each size. A block keeps its best ``k`` rows, and a day's best
are among those of the blocks that hold it, one of each size. So a row costs the logarithm of
its interval's length, not the length, and no day ever meets all rows that hold on it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = "_a", "_b"  # day numbers of an interval, both included
BLOCK = ["_size", "_block"]  # binary logarithm of a block's days, and its place among blocks of that size
CHUNK = 32  # neighbouring days that share a limit in ``contenders``


def dyadic_blocks(rows: DataFrame, days: int) -> DataFrame:
    """Rows once per block of their interval; intervals lie within day numbers 0 to ``days`` - 1."""
    last = max(days, 1).bit_length()
    blocks = F.expr(f"""
        filter(flatten(transform(sequence(0, {last}), s -> transform(
          array(named_struct('s', s, 'lo', ({FIRST} + shiftleft(1L, s) - 1) div shiftleft(1L, s), 'hi', ({LAST} + 1) div shiftleft(1L, s))),
          x -> array(
            CASE WHEN x.lo < x.hi AND x.lo % 2 = 1 THEN named_struct('size', x.s, 'block', x.lo) END,
            CASE WHEN x.lo < x.hi AND x.hi % 2 = 1 THEN named_struct('size', x.s, 'block', x.hi - 1) END))[0])), x -> x IS NOT NULL)""")
    return rows.withColumn("_x", F.explode(blocks)).select(
        *rows.columns, F.col("_x.size").alias(BLOCK[0]), F.col("_x.block").alias(BLOCK[1]))


def contenders(rows: DataFrame, days: int, lead: str, k: int, kinds: list[str] | None = None, bins: int = 64) -> DataFrame:
    """Intervals cut to the days on which their row may be among the first ``k`` by ``lead``, largest first.

    Values are dealt to ranges by a mergeable sketch, and running sums of starts and ends tell
    how many rows of each range hold on a day. A row whose range lies below the highest ranges
    that hold ``k`` rows together is not among that day's first. So only about ``k`` rows a day
    and one range of the rest go on. The sketch decides only how many rows that are; the
    first ``k`` are among them for any cut points. Days share a limit by ``CHUNK``, so an
    interval falls into few parts.
    """
    kinds = kinds or []
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = rows.where(~F.isnan(lead)).agg(F.percentile_approx(lead, probs, F.lit(bins * 20))).scalar()
    place = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(lead))), F.lit(0))
    ranged = rows.withColumn("_cuts", cuts).withColumn("_range", F.struct(*kinds, place.alias("_r"))).drop("_cuts")
    change = F.explode(F.array(F.struct(F.col(FIRST).alias("seq"), F.lit(1).alias("n")),
                               F.struct((F.col(LAST) + 1).alias("seq"), F.lit(-1).alias("n"))))
    steps = (ranged.select("_range", change.alias("c")).groupBy("_range", F.col("c.seq").alias("seq")).agg(F.sum("c.n").alias("_n"))
             .withColumn("_to", F.coalesce(F.lead("seq").over(Window.partitionBy("_range").orderBy("seq")) - 1, F.lit(days))))
    ahead = Window.partitionBy("_range").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    # From here on at most one row per range and day.
    held = (steps.withColumn("_n", F.sum("_n").over(ahead)).where((F.col("_n") > 0) & (F.col("seq") <= F.col("_to")))
            .withColumn("seq", F.explode(F.sequence("seq", "_to"))))
    group = [F.col(f"_range.{c}") for c in kinds]
    above = Window.partitionBy("seq", *group).orderBy(F.desc("_range._r")).rowsBetween(Window.unboundedPreceding, -1)
    open_to = held.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).where(F.col("_above") < k)
    size = F.lit(CHUNK)
    chunks = open_to.select("_range", F.floor(F.col("seq") / size).alias("seq")).distinct()
    allowed = spans(chunks, "_range").select("_range", (F.col("_lo") * size).alias("_lo"), ((F.col("_hi") + 1) * size - 1).alias("_hi"))
    return within(ranged, F.broadcast(allowed), "_range").drop("_range")


def top_by_day(rows: DataFrame, days: int, order: Callable[[], list[Column]], k: int, rank: str = "_k", *,
               lead: str | None = None, kinds: list[str] | None = None, spare: int = 0, daily: Callable[[DataFrame], DataFrame] | None = None,
               day_order: Callable[[], list[Column]] | None = None) -> DataFrame:
    """The first ``k`` rows of each day (``seq``) by ``order``, numbered from 1 as ``rank``.

    ``order`` is called on the rows of blocks and may use ``BLOCK``. Both limits are kept inside
    every task before its rows are shuffled. If ``order`` begins with a number, largest first,
    ``lead`` names it, and only ``contenders`` go to blocks. Where a row's value changes from day to day,
    ``daily`` computes it, the day's rows are ranked by ``day_order``, and ``order`` must rank
    the rows of one of the ``kinds`` (columns) alike on every day; a block then keeps its best
    of each kind, and ``spare`` more in case rounding swaps neighbours.
    """
    def first(df: DataFrame, group: list[str], name: str, by: list[Column], most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*group).orderBy(*by))
        return df.withColumn(name, place).where(F.col(name) <= most)

    rows = contenders(rows, days, lead, k + spare, kinds) if lead else rows
    of_blocks = first(dyadic_blocks(rows, days), BLOCK + (kinds or []), "_place", order(), k + spare).drop("_place")
    spread = of_blocks.withColumn("seq", F.explode(F.expr(
        "sequence(shiftleft(_block, _size), shiftleft(_block + 1, _size) - 1)")))
    spread = daily(spread) if daily else spread
    return first(spread, ["seq"], rank, (day_order or order)(), k).drop(FIRST, LAST, *BLOCK, *(kinds or []))


def spans(rows: DataFrame, key: str) -> DataFrame:
    """Runs of consecutive day numbers (key, seq) as intervals (key, _lo, _hi)."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return (rows.select(key, "seq", (F.col("seq") - place).alias("_run")).groupBy(key, "_run")
            .agg(F.min("seq").alias("_lo"), F.max("seq").alias("_hi")).drop("_run"))


def within(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Intervals cut to the spans of their key; a row once per span that it meets."""
    return (rows.join(allowed, key).where((F.col(FIRST) <= F.col("_hi")) & (F.col(LAST) >= F.col("_lo")))
            .withColumn(FIRST, F.greatest(FIRST, "_lo")).withColumn(LAST, F.least(LAST, "_hi")).select(*rows.columns))
