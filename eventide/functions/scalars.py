"""Scalar expressions. All are built-in column expressions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output formats and constants that results must agree on.
ENTITY_PREFIX = "COMP"
DAYS_PER_MONTH = 30.4375
MAX_FILING_DELAY_DAYS = 180
MAX_MONTHS_SINCE_PERIOD = 24.0
FISCAL_PERIODS = {"Q1": 1.0, "Q2": 2.0, "Q3": 3.0, "Q4": 4.0, "FY": 4.0}
MAD_TO_SIGMA = 1.4826


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: Column | str, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; null stays null."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def normalize_entity_key(raw: Column | str) -> Column:
    """First run of digits, zero-padded to at least ten; null when there is none."""
    digits = F.regexp_extract(_c(raw).cast("string"), r"\d+", 0)
    width = F.greatest(F.length(digits), F.lit(10))
    return F.when(digits != "", F.lpad(digits, width, F.lit("0")))


def entity_id(raw: Column | str) -> Column:
    return F.concat(F.lit(ENTITY_PREFIX), normalize_entity_key(raw))


def hash_id(prefix: str, parts: list[Column | str], width: int) -> Column:
    """``prefix`` + leading hex digits of the SHA-1 of the ``|``-joined parts."""
    joined = F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha1(joined), 1, width))


def hash_bucket(key: Column | str, buckets: int) -> Column:
    """Stable bucket from the first eight hex digits of the SHA-1 of ``key``."""
    head = F.conv(F.substring(F.sha1(_c(key)), 1, 8), 16, 10)
    return (head.cast("bigint") % F.lit(buckets)).cast("int")


def industry_division(code: Column | str) -> Column:
    """First digit of a four-digit industry code; null when no digits are present."""
    digits = F.regexp_replace(_c(code).cast("string"), r"\D", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(4)), F.lit("0"))
    return F.when(digits != "", F.substring(padded, 1, 1))


def eastern_date(value: Column | str) -> Column:
    """Calendar date in New York of an ISO timestamp string.

    Without a zone suffix the text is already New York time. Text that is not
    a timestamp falls back to its first ten characters.
    """
    s = _c(value)
    zoned = s.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    instant = F.try_to_timestamp(s)
    as_utc = F.to_utc_timestamp(instant, F.current_timezone())
    local = F.to_date(F.from_utc_timestamp(as_utc, F.lit("America/New_York")))
    head = F.expr(f"try_cast(substr({value}, 1, 10) as date)") if isinstance(value, str) else (
        F.try_to_date(F.substring(s, 1, 10)))
    return F.coalesce(F.when(zoned, local), head)


def eastern_instant(value: Column | str) -> Column:
    """Instant of an ISO-like text; without a zone suffix the text is New York time."""
    s = _c(value)
    zoned = s.rlike(r"[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$")
    wall = F.convert_timezone(F.lit("America/New_York"), F.current_timezone(), s.try_cast("timestamp_ntz"))
    return F.when(zoned, s.try_cast("timestamp")).otherwise(wall.cast("timestamp"))


def event_day(df: DataFrame, name: str = "accepted_datetime") -> Column:
    """Eastern calendar day of an event's time column, whatever its type and the session's zone.

    A timestamp is an instant; text without a zone and a date are Eastern already.
    """
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return eastern_date(name)
    if kind in ("date", "timestamp_ntz"):
        return F.to_date(name)
    wall = F.col(name).cast("timestamp_ntz")
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("America/New_York"), wall))


def to_double(x: Column | str) -> Column:
    """Number or null; text that is not a number never fails the job."""
    return _c(x).try_cast("double")


def log_return(now: Column | str, before: Column | str) -> Column:
    now, before = _c(now), _c(before)
    return F.when((now > 0) & (before > 0), F.log(now / before))


def simple_return(now: Column | str, before: Column | str) -> Column:
    return F.try_divide(_c(now), _c(before)) - 1.0


def signed_log(x: Column | str) -> Column:
    x = _c(x)
    return F.signum(x) * F.log1p(F.abs(x))


def robust_scaled(x: Column, median: Column, iqr: Column, *, lo: float = -10.0,
                  hi: float = 10.0, floor: float = 1e-6) -> Column:
    """(x - median) / IQR with a floor on the spread, clipped; missing becomes 0.

    A spread below 1e-9 of the median's size (of 1, if that is smaller) is rounding and counts as none.
    """
    spread = F.when(iqr > 1e-9 * F.greatest(F.lit(1.0), F.abs(median)), iqr).otherwise(F.lit(floor))
    return F.coalesce(clip((x - median) / spread, lo, hi), F.lit(0.0))


def tanh_target(ret: Column | str, scale: Column | str, k: float = 2.5) -> Column:
    scale = _c(scale)
    return F.when(scale > 0, clip(F.tanh(_c(ret) / (F.lit(k) * scale)), -1.0, 1.0))


def restore_signal(signal: Column | str, scale: Column | str, *, k: float = 2.5,
                   method: str = "atanh", limit: float = 0.99) -> Column:
    """Signal in [-1, 1] back to an expected log return; null without a scale."""
    s, scale = _c(signal), _c(scale)
    core = s if method == "linear" else F.atanh(clip(s, -limit, limit))
    return F.when(scale > 0, core * F.lit(k) * scale)


def filing_delay_days(accepted: Column | str, period_end: Column | str) -> Column:
    days = F.datediff(_c(accepted), _c(period_end))
    return F.coalesce(clip(days, 0, MAX_FILING_DELAY_DAYS), F.lit(0)).cast("double")


def fiscal_period_index(period: Column | str) -> Column:
    table = F.create_map(*[F.lit(v) for kv in FISCAL_PERIODS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, F.upper(_c(period))), F.lit(0.0))


def months_since(entry: Column | str, period_end: Column | str) -> Column:
    months = F.datediff(_c(entry), _c(period_end)) / F.lit(DAYS_PER_MONTH)
    return F.coalesce(clip(months, 0.0, MAX_MONTHS_SINCE_PERIOD), F.lit(0.0))


def quarter_label(d: Column | str) -> Column:
    d = _c(d)
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def damping(z: Column, kt: float = 2.0, floor: float = 0.3, ceiling: float = 1.0) -> Column:
    """exp(-max(0, z) / kt), clipped."""
    return clip(F.exp(-F.greatest(F.lit(0.0), z) / F.lit(kt)), floor, ceiling)


def confidence_label(rank_pct: Column | str) -> Column:
    p = _c(rank_pct)
    return (F.when(p >= 0.85, "high").when(p >= 0.70, "moderate").when(p >= 0.30, "neutral")
            .when(p >= 0.15, "moderate-avoid").otherwise("avoid"))


def direction_label(signal: Column | str, band: float = 0.05) -> Column:
    s = _c(signal)
    return F.when(s > band, "up").when(s < -band, "down").otherwise("flat")


def annualised_vol(scale: Column | str, holding_days: Column | str) -> Column:
    days = F.when(_c(holding_days) == 0, F.lit(60)).otherwise(_c(holding_days))
    return _c(scale) / F.greatest(F.lit(1.0), F.sqrt(days)) * F.sqrt(F.lit(252.0))


def correlation(x: Column | str, y: Column | str) -> Column:
    """Aggregate correlation; null, not an error, when either side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
