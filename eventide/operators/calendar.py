"""Trading calendar as a small dimension table.

The table has one row per calendar date of a bounded range, so it is the one
relation this library broadcasts by hint. ``MAX_YEARS`` is the checked bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_YEARS = 200


def _div(a: Column, b: int | Column) -> Column:
    return F.floor(a / (F.lit(b) if isinstance(b, int) else b))


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by Oudin's integer method."""
    century = _div(year, 100)
    golden = year % 19
    k = _div(century - 17, 25)
    i = (century - _div(century, 4) - _div(century - k, 3) + golden * 19 + 15) % 30
    q = _div(i, 28)
    i = i - q * (F.lit(1) - q * _div(F.lit(29), i + 1) * _div(F.lit(21) - golden, 11))
    j = (year + _div(year, 4) + i + 2 - century + _div(century, 4)) % 7
    offset = i - j
    month = F.lit(3) + _div(offset + 40, 44)
    day = offset + 28 - F.lit(31) * _div(month, 4)
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def is_market_holiday(date: Column) -> Column:
    """Rule-based test on the date itself; no holiday list is built or joined."""
    month, day, iso_dow = F.month(date), F.dayofmonth(date), F.weekday(date)
    monday, thursday, friday = iso_dow == 0, iso_dow == 3, iso_dow == 4

    def nth(which: Column, m: int, n: int) -> Column:
        return which & (month == m) & day.between(7 * n - 6, 7 * n)

    def fixed(m: int, d: int) -> Column:
        """The day itself, or the Friday before / Monday after when on a weekend."""
        eve, morrow = F.date_add(date, 1), F.date_sub(date, 1)
        return (((month == m) & (day == d))
                | (friday & (F.month(eve) == m) & (F.dayofmonth(eve) == d))
                | (monday & (F.month(morrow) == m) & (F.dayofmonth(morrow) == d)))

    last_monday_of_may = monday & (month == 5) & (day >= 25)
    good_friday = friday & (F.date_add(date, 2) == easter_sunday(F.year(date)))
    return (fixed(1, 1) | nth(monday, 1, 3) | nth(monday, 2, 3) | good_friday
            | last_monday_of_may | (fixed(6, 19) & (F.year(date) >= 2021)) | fixed(7, 4)
            | nth(monday, 9, 1) | nth(thursday, 11, 4) | fixed(12, 25))


def calendar_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    return calendar_over(spark.range(1).select(F.lit(start).cast("date").alias("start"),
                                               F.lit(end).cast("date").alias("end")))


def calendar_over(bounds: DataFrame) -> DataFrame:
    """Calendar for the one-row range (start, end), which may itself be an aggregate.

    One row per calendar date with ``is_trading_day``, ``seq`` (index of the
    last trading day at or before the date), and the strictly next and
    previous trading days.
    """
    years = F.year("end") - F.year("start")
    fits = F.when((years >= 0) & (years <= MAX_YEARS), F.col("end")).otherwise(
        F.raise_error(F.lit(f"calendar range must run forward and span at most {MAX_YEARS} years"))
        .cast("date"))
    days = bounds.select(F.explode(F.sequence(F.col("start"), fits)).alias("date"))
    days = days.withColumn("is_trading_day",
                           (F.weekday("date") < 5) & ~is_market_holiday(F.col("date")))
    return _with_neighbours(days)


def calendar_of_dates(dates: DataFrame, column: str = "date") -> DataFrame:
    """Calendar whose trading days are exactly the distinct dates given."""
    given = dates.select(F.col(column).cast("date").alias("date")).distinct()
    span = given.agg(F.min("date").alias("start"), F.max("date").alias("end"))
    days = span.select(F.explode(F.sequence("start", "end")).alias("date"))
    return _with_neighbours(days.join(given.withColumn("_hit", F.lit(True)), "date", "left")
                            .select("date", F.coalesce("_hit", F.lit(False))
                                    .alias("is_trading_day")))


def _with_neighbours(days: DataFrame) -> DataFrame:
    # Unpartitioned windows are safe here: at most 366 * MAX_YEARS rows.
    up = Window.partitionBy(F.lit(0)).orderBy("date")
    down = Window.partitionBy(F.lit(0)).orderBy(F.col("date").desc())
    trading = F.when(F.col("is_trading_day"), F.col("date"))
    before = (Window.unboundedPreceding, -1)
    return days.select(
        "date", "is_trading_day",
        (F.count(trading).over(up.rowsBetween(Window.unboundedPreceding, 0)) - 1)
        .cast("int").alias("seq"),
        F.min(trading).over(down.rowsBetween(*before)).alias("next_td"),
        F.max(trading).over(up.rowsBetween(*before)).alias("prev_td"))


def trading_days(calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """(date, seq) of trading days only, renumbered from 0 inside [start, end]."""
    days = calendar.where("is_trading_day")
    if start:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        days = days.where(F.col("date") <= F.lit(end).cast("date"))
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return days.select("date", (F.row_number().over(w) - 1).cast("int").alias("seq"))


def with_neighbour(df: DataFrame, calendar: DataFrame, date: str, out: str,
                   direction: str) -> DataFrame:
    """Add the strictly next or previous trading day of ``date``; null off the calendar."""
    column = {"next": "next_td", "previous": "prev_td"}[direction]
    return df.join(F.broadcast(calendar.select(F.col("date").alias(date),
                                               F.col(column).alias(out))), date, "left")


def with_trading_days_between(df: DataFrame, calendar: DataFrame, start: str, end: str,
                              out: str) -> DataFrame:
    """Inclusive number of trading days from ``start`` to ``end``."""
    a = calendar.select(F.col("date").alias(start), F.col("seq").alias("_a"),
                        F.col("is_trading_day").alias("_open"))
    b = calendar.select(F.col("date").alias(end), F.col("seq").alias("_b"))
    first = F.when(F.col("_open"), F.col("_a")).otherwise(F.col("_a") + 1)
    return (df.join(F.broadcast(a), start, "left").join(F.broadcast(b), end, "left")
            .withColumn(out, F.col("_b") - first + 1).drop("_a", "_b", "_open"))
