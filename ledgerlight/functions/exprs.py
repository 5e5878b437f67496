"""Column-expression helpers shared by the jobs.

All of these are built-in Spark expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sunday_week(ts: str | Column) -> Column:
    """Week of year with weeks starting on Sunday, 0..53 (days before the
    first Sunday are week 0), the strftime ``%U`` convention."""
    d = F.to_date(col(ts))
    return F.floor((F.dayofyear(d) + F.lit(7) - F.dayofweek(d)) / F.lit(7)).cast("int")


def year_week_key(ts: str | Column) -> Column:
    """Grouping key ``<year>W<sunday week>`` as text."""
    return F.concat(F.year(col(ts)).cast("string"), F.lit("W"), sunday_week(ts).cast("string"))


def safe_div(num: Column, den: Column) -> Column:
    """num / den, NULL when den is 0 or NULL (SQL ``NULLIF`` idiom)."""
    return num / F.nullif(den, F.lit(0))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    """Fractional days between two timestamps."""
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) \
        / F.lit(86_400_000_000.0)


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    return (F.unix_micros(col(later).cast("timestamp")) - F.unix_micros(col(earlier).cast("timestamp"))) \
        / F.lit(1_000_000.0)


def ts_literal(value) -> Column:
    """Timestamp literal without time-zone shifts: a naive datetime is read
    as wall-clock time (TIMESTAMP_NTZ), like the driver's parquet columns."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def exact_avg(c: str | Column) -> Column:
    """Mean over a decimal copy of the values, so a mean lying exactly on a
    rounding tie stays on it (summing doubles can leave it a hair off)."""
    return F.avg(col(c).cast("decimal(38,9)"))


# Engagement-score weights and caps of the event job.
SCORE_FEATURE_CAP = 20
SCORE_EVENT_CAP = 500
SCORE_DURATION_CAP = 600
SCORE_RECENCY_DAYS = 90
SCORE_WEIGHTS = (0.20, 0.30, 0.25, 0.25)


def engagement_score(features: Column, events: Column, avg_duration: Column, days_since: Column) -> Column:
    """Weighted engagement score in [0, 1], rounded half-even to 3 dp."""
    w_f, w_e, w_d, w_r = SCORE_WEIGHTS
    raw = (F.least(features / F.lit(float(SCORE_FEATURE_CAP)), F.lit(1.0)) * F.lit(w_f)
           + F.least(events / F.lit(float(SCORE_EVENT_CAP)), F.lit(1.0)) * F.lit(w_e)
           + F.least(avg_duration / F.lit(float(SCORE_DURATION_CAP)), F.lit(1.0)) * F.lit(w_d)
           + F.greatest(F.lit(1.0) - days_since / F.lit(float(SCORE_RECENCY_DAYS)), F.lit(0.0)) * F.lit(w_r))
    return F.bround(raw, 3)


# Value bands and per-event ARPU multipliers.
BAND_HIGH, BAND_MEDIUM = 0.75, 0.50
ARPU_HIGH, ARPU_MEDIUM, ARPU_LOW = 120, 80, 40


def value_band(score: Column) -> Column:
    return (F.when(score >= BAND_HIGH, "High").when(score >= BAND_MEDIUM, "Medium").otherwise("Low"))


def potential_arpu(score: Column, events: Column) -> Column:
    mult = F.when(score >= BAND_HIGH, ARPU_HIGH).when(score >= BAND_MEDIUM, ARPU_MEDIUM).otherwise(ARPU_LOW)
    return (mult * events).cast("bigint")


def positional_hits(a: str | Column, b: str | Column) -> Column:
    """Positions 1..max(len) where the lower-cased texts have the same character."""
    la, lb = F.lower(col(a)), F.lower(col(b))
    n = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda acc, i: acc + F.when((i <= n) & (F.substring(la, i, 1) == F.substring(lb, i, 1))
                                    & (F.length(F.substring(la, i, 1)) > 0), 1).otherwise(0))


def positional_similarity(a: str | Column, b: str | Column) -> Column:
    """Equal characters at equal positions of the lower-cased texts over the
    longer length, x100, rounded to 2 dp; NULL when both texts are empty."""
    n = F.greatest(F.length(col(a)), F.length(col(b)))
    return F.round(positional_hits(a, b).cast("double") / F.nullif(n, F.lit(0)).cast("double") * F.lit(100.0), 2)
