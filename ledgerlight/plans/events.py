"""Event analytics: sessions per week by tier, feature DAU and 7-day
retention, onboarding funnel (plain and ordered), engaged free users.

Input is the canonical events table (``customer_id, user_id, event_type,
feature_name, subscription_tier, timestamp, properties.duration_seconds``).
Rounding of outputs is half-even (the document store's ``$round``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.functions.exprs import (
    days_between, engagement_score, exact_avg, potential_arpu, seconds_between, ts_literal, value_band,
    year_week_key)
from ledgerlight.operators.ranking import exact_quantiles, nearest_rank_percentiles
from ledgerlight.session import materialize
from ledgerlight.sources.event_days import time_bounds


def _ts(as_of: dt.datetime):
    return ts_literal(as_of)


def _since(as_of: dt.datetime, days_back: int):
    return _ts(as_of) - F.expr(f"INTERVAL {int(days_back)} DAYS")


# ---------------------------------------------------------------- MQ1

def sessions_by_tier(events: DataFrame, as_of: dt.datetime, days_back: int = 90,
                     session_events: Sequence[str] = ("session_start", "session_end", "feature_use"),
                     partitions: int | None = None) -> DataFrame:
    """MQ1: per tier, users, mean weekly event count and nearest-rank
    p25/p50/p75 of each user's mean duration.

    Three regroupings: (user, tier, Sunday-week) -> (user, tier) -> tier.
    The weekly count counts events of the session types (``sessionsInWeek``
    in the reference). Missing duration is 0, missing tier 'unknown'. The
    percentiles run on (tier, value) counts, spread over value buckets when a
    tier is large (see ``operators.ranking``), never on a per-tier list.
    """
    e = time_bounds(events, _since(as_of, days_back)).where(F.col("event_type").isin(list(session_events)))
    e = e.select("user_id",
                 F.coalesce(F.col("subscription_tier"), F.lit("unknown")).alias("tier"),
                 year_week_key("timestamp").alias("year_week"),
                 F.coalesce(F.col("properties.duration_seconds").cast("double"), F.lit(0.0)).alias("dur"))
    weekly = e.groupBy("user_id", "tier", "year_week").agg(
        F.count(F.lit(1)).alias("sessionsInWeek"), F.avg("dur").alias("avgDuration"))
    per_user = weekly.groupBy("user_id", "tier").agg(
        F.count(F.lit(1)).alias("weeksActive"),
        F.avg("sessionsInWeek").alias("avgSessionsPerWeek"),
        F.avg("avgDuration").alias("avgDurationPerSession"))
    per_user = materialize(per_user)  # one row per (user, tier), read by three passes
    per_tier = per_user.groupBy("tier").agg(
        F.count(F.lit(1)).alias("userCount"),
        F.avg("avgSessionsPerWeek").alias("avgSessionsPerWeek"))
    pct = nearest_rank_percentiles(per_user, ["tier"], "avgDurationPerSession",
                                   {"p25": 0.25, "p50": 0.50, "p75": 0.75}, partitions=partitions)
    return per_tier.join(pct, "tier", "left").select(
        "tier", "userCount",
        F.bround("avgSessionsPerWeek", 2).alias("avgSessionsPerWeek"),
        F.bround("p25", 2).alias("percentile_25"),
        F.bround("p50", 2).alias("percentile_50"),
        F.bround("p75", 2).alias("percentile_75"),
    ).orderBy(F.col("avgSessionsPerWeek").desc(), "tier")


# ---------------------------------------------------------------- MQ2 / MQ2r

def active_days(events: DataFrame, as_of: dt.datetime, days_back: int,
                feature_events: Sequence[str], key: str = "feature_name") -> DataFrame:
    """Distinct (user, key, UTC day) rows of qualifying events."""
    e = time_bounds(events, _since(as_of, days_back)).where(
        F.col("event_type").isin(list(feature_events)) & F.col(key).isNotNull())
    return e.select("user_id", F.col(key).alias("key"), F.to_date("timestamp").alias("day")).distinct()


def retention(days: DataFrame, as_of: dt.datetime | None = None, horizon: int = 7,
              mature_only: bool = False) -> DataFrame:
    """MQ2r: per key, share of users (cohort = first active day d0 of that
    user for that key) active again on a day in (d0, d0 + horizon].

    Input: distinct (user_id, key, day). A (user, key) group holds at most one
    row per day of the window, so collecting its days is bounded.
    ``mature_only`` drops cohorts whose horizon ends after ``as_of``.
    """
    per = days.groupBy("user_id", "key").agg(F.array_sort(F.collect_set("day")).alias("ds"))
    per = per.select("key", F.element_at("ds", 1).alias("d0"),
                     F.when(F.size("ds") >= 2, F.element_at("ds", 2)).alias("d1"))
    if mature_only and as_of is not None:
        per = per.where(F.date_add("d0", horizon) <= F.to_date(_ts(as_of)))
    kept = F.col("d1").isNotNull() & (F.col("d1") <= F.date_add("d0", horizon))
    return per.groupBy("key").agg(
        F.count(F.lit(1)).alias("cohort_users"),
        F.count(F.when(kept, 1)).alias("retained_users"),
    ).withColumn("retention", F.bround(F.col("retained_users") / F.col("cohort_users"), 3))


def feature_dau_retention(events: DataFrame, as_of: dt.datetime, days_back: int = 30, limit: int = 50,
                          feature_events: Sequence[str] = ("feature_use",), horizon: int = 7,
                          mature_only: bool = False) -> DataFrame:
    """MQ2: per feature, mean daily distinct users over the days it was used
    (rounded half-even to 0 dp) and 7-day retention; top ``limit`` by DAU
    (ties by feature name)."""
    days = active_days(events, as_of, days_back, feature_events)
    dau = days.groupBy("key", "day").agg(F.count(F.lit(1)).alias("users")) \
        .groupBy("key").agg(F.avg("users").alias("dau"))
    ret = retention(days, as_of, horizon, mature_only)
    out = dau.join(ret, "key").select(
        F.col("key").alias("feature"),
        F.bround("dau", 0).alias("dau"),
        F.col("retention").alias("retention7Day"))
    return out.orderBy(F.col("dau").desc(), "feature").limit(limit)


# ---------------------------------------------------------------- MQ3 / MQ3t

def funnel(events: DataFrame, stages: Sequence[str], ordered: bool = False,
           since: dt.datetime | None = None, until: dt.datetime | None = None) -> DataFrame:
    """MQ3: distinct users reaching each stage, conversion from the previous
    stage (0 when the previous count is 0, rounded half-even to 3 dp) and
    drop-off = 1 - conversion.

    ``ordered=False`` counts users with any event of the stage (the
    reference). ``ordered=True`` requires the stages in order: a user reaches
    stage k at the first stage-k event at or after reaching stage k-1, and
    ``median_seconds_from_prev`` gives the exact median of those gaps.
    Optional ``since``/``until`` bound the event time.
    """
    e = time_bounds(events, since, until).where(F.col("event_type").isin(list(stages)) & F.col("user_id").isNotNull())
    spark = events.sparkSession
    stage_df = spark.createDataFrame([(s, i + 1) for i, s in enumerate(stages)], "stage string, step_number int")
    if not ordered:
        counts = e.select("user_id", F.col("event_type").alias("stage")).distinct() \
            .groupBy("stage").agg(F.count(F.lit(1)).alias("count"))
        base = F.broadcast(stage_df).join(counts, "stage", "left") \
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("bigint"))
    else:
        base = _ordered_counts(e, stages, stage_df)
    w = Window.orderBy("step_number")  # one row per stage: a handful of rows
    prev = F.lag("count").over(w)
    conv = F.when(F.col("step_number") == 1, F.lit(1.0)).when(F.coalesce(prev, F.lit(0)) == 0, F.lit(0.0)) \
        .otherwise(F.bround(F.col("count") / prev, 3))
    out = base.withColumn("conversionRate", conv) \
        .withColumn("dropOffRate", F.bround(F.lit(1.0) - F.col("conversionRate"), 3))
    cols = ["stage", "step_number", "count", "conversionRate", "dropOffRate"]
    if ordered:
        cols.append("median_seconds_from_prev")
    return out.select(*cols).orderBy("step_number")


def funnel_segments(e: DataFrame, stages: Sequence[str], partitions: int | None = None) -> DataFrame:
    """What every time range of a user's events does to the user's progress:
    (user_id, part, chains), at most one row per user and part.

    Events are dealt out by ranges of (user, time), so a user with a third of
    all events has many parts, and parts of a user follow each other in time.
    ``chains[j]`` holds the times at which a user who enters the part with j
    stages reached gets to stage j + 1, j + 2 and so on inside it."""
    n = len(stages)
    bit = F.coalesce(*[F.when(F.col("event_type") == s, F.lit(1 << k)) for k, s in enumerate(stages)])
    # events of one instant are one row: their stages as bits
    instants = e.where(F.col("timestamp").isNotNull()).select("user_id", "timestamp", bit.alias("bit")) \
        .groupBy("user_id", "timestamp").agg(F.bit_or("bit").alias("bits"))
    keys = ["user_id", "timestamp"]
    dealt = instants.repartitionByRange(partitions, *keys) if partitions else instants.repartitionByRange(*keys)
    rows = materialize(dealt.withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("user_id", "part")   # one sort serves all steps
    at = lambda j, s: f"t{j}_{s}"
    for step in range(1, n + 1):
        new = {}
        for j in range(n - step + 1):
            s = j + step
            hit = F.col("bits").bitwiseAND(F.lit(1 << (s - 1))) != 0
            if step > 1:
                hit = hit & (F.col("timestamp") >= F.col(at(j, s - 1)))
            new[at(j, s)] = F.min(F.when(hit, F.col("timestamp"))).over(inside)
        rows = rows.withColumns(new)
    chain = [F.filter(F.array(*[F.col(at(j, s)) for s in range(j + 1, n + 1)]), lambda t: t.isNotNull()) for j in range(n)]
    once = rows.groupBy("user_id", "part").agg(*[F.first(at(j, s)).alias(at(j, s)) for j in range(n) for s in range(j + 1, n + 1)])
    nothing = F.array().cast(f"array<{dict(e.dtypes)['timestamp']}>")
    return once.select("user_id", "part", F.array(*chain, nothing).alias("chains"))


def _ordered_counts(e: DataFrame, stages: Sequence[str], stage_df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Per stage, users reaching it in order and the median seconds from the
    previous stage, from one pass over the events: a user's segments are folded
    in the order of time (as many as there are parts at most)."""
    folded = funnel_segments(e, stages, partitions).groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("part", "chains"))).alias("parts")).select(
        F.expr(f"aggregate(parts, cast(array() as array<{dict(e.dtypes)['timestamp']}>), "
               "(t, p) -> concat(t, p.chains[size(t)]))").alias("times"))
    reached = folded.select("times", F.posexplode("times").alias("k", "t"))
    gaps = materialize(reached.select(
        F.element_at(F.array(*[F.lit(s) for s in stages]), F.col("k") + 1).alias("stage"),
        F.when(F.col("k") > 0, seconds_between("t", F.expr("times[greatest(k - 1, 0)]"))).alias("gap")))
    counts = gaps.groupBy("stage").agg(F.count(F.lit(1)).alias("count"))
    med = exact_quantiles(gaps.where(F.col("gap").isNotNull()), ["stage"], "gap", {"median": 0.5})
    return F.broadcast(stage_df).join(counts, "stage", "left").join(med, "stage", "left").select(
        "stage", "step_number",
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
        F.round("median", 3).alias("median_seconds_from_prev"))


# ---------------------------------------------------------------- MQ4

def engaged_users(events: DataFrame, as_of: dt.datetime, tier: str = "free", days_back: int = 90,
                  min_events: int = 5, limit: int = 20, default_duration: float = 30.0,
                  recent_days: int = 7, nested: bool = True) -> DataFrame:
    """MQ4: top ``limit`` users of ``tier`` by engagement score, with their
    metrics, value band and potential ARPU (ties by userId).

    One ``groupBy(user)`` with partial aggregation; distinct counts are the
    only exact-set aggregates and are bounded by features / event types.
    """
    e = time_bounds(events, _since(as_of, days_back)).where(F.col("subscription_tier") == tier)
    ds = days_between(_ts(as_of), F.col("timestamp"))
    dur = F.coalesce(F.col("properties.duration_seconds").cast("double"), F.lit(float(default_duration)))
    e = e.select("user_id", "feature_name", "event_type", ds.alias("days_since"), dur.alias("dur"))
    g = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("totalEvents"),
        F.countDistinct("feature_name").alias("featureDiversity"),
        exact_avg("dur").cast("double").alias("avgDur"),
        F.max("dur").alias("maxSessionDuration"),
        F.min("days_since").alias("minDays"),
        F.count(F.when(F.col("days_since") <= recent_days, 1)).alias("recentActivityCount"),
        F.countDistinct("event_type").alias("uniqueEventTypes"),
    ).where(F.col("totalEvents") >= min_events)
    score = engagement_score(F.col("featureDiversity"), F.col("totalEvents"), F.col("avgDur"), F.col("minDays"))
    g = g.withColumn("engagementScore", score)
    top = g.orderBy(F.col("engagementScore").desc(), F.col("user_id")).limit(limit)
    metrics = [
        F.col("featureDiversity"),
        F.col("totalEvents").alias("usageFrequency"),
        F.bround("avgDur", 2).alias("avgSessionDuration"),
        F.bround("minDays", 1).alias("daysSinceLastActive"),
        F.col("recentActivityCount"),
        F.col("uniqueEventTypes"),
        F.col("maxSessionDuration"),
    ]
    head = [F.col("user_id").alias("userId")]
    tail = [F.col("engagementScore"),
            value_band(F.col("engagementScore")).alias("potentialValue"),
            potential_arpu(F.col("engagementScore"), F.col("totalEvents")).alias("potentialArpu")]
    if nested:
        out = top.select(*head, F.struct(*metrics).alias("metrics"), *tail)
    else:
        out = top.select(*head, *metrics, *tail)
    return out.orderBy(F.col("engagementScore").desc(), "userId")
