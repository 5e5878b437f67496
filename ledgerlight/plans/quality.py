"""Data-quality profile of an events table (DQ1-DQ9).

Each check is one aggregation pass with partial (map-side) aggregation; the
results are small frames. ``quality_report`` gathers them in long format
(section, key, metric, value, text).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.sources.tables import sample

# Fields the profiler requires, and the expected domains.
REQUIRED_FIELDS = ("user_id", "timestamp", "event_type", "subscription_tier")
EXPECTED_EVENTS = ("signup", "first_login", "workspace_created", "first_project", "invited_teammate",
                   "feature_use", "session_start", "session_end", "nps_response", "onboarding_complete")
EXPECTED_TIERS = ("free", "pro", "enterprise", "unknown")
NULL_LIKE_TEXT = ("", "null")


def _pct(n: F.Column, total: F.Column) -> F.Column:
    return F.bround(F.when(total > 0, n.cast("double") / total * F.lit(100.0)).otherwise(F.lit(0.0)), 2)


def missing_values(events: DataFrame, fields: Sequence[str] = REQUIRED_FIELDS) -> DataFrame:
    """DQ1: NULL count and percentage per required field (counted once)."""
    aggs = [F.count(F.lit(1)).alias("__total")]
    aggs += [F.count_if(F.col(f).isNull()).alias(f) for f in fields]
    wide = events.agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}`" for f in fields)
    long = wide.select("__total", F.expr(f"stack({len(fields)}, {stack}) AS (field, count)"))
    return long.select("field", F.col("count").cast("bigint").alias("count"),
                       _pct(F.col("count"), F.col("__total")).alias("percentage"))


def duplicate_groups(events: DataFrame, id_col: str = "event_id") -> DataFrame:
    """DQ2: groups of (user_id, event_type, timestamp to the second) with more
    than one event, with their size and first/last event id. All groups are
    returned; the ids are bounded aggregates, never a collected list."""
    sec = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")
    return events.groupBy("user_id", "event_type", sec.alias("second")).agg(
        F.count(F.lit(1)).alias("count"),
        F.min(id_col).alias("first_id"),
        F.max(id_col).alias("last_id"),
    ).where(F.col("count") > 1)


def duplicate_samples(events: DataFrame, n: int = 5, id_col: str = "event_id") -> DataFrame:
    """DQ2 samples: every duplicate group with its size and its ``n`` smallest
    ids. The window keeps ``n`` rows of a group in every task before the shuffle
    and once more after it, so a group of any size is never gathered."""
    key = ["user_id", "event_type", "second"]
    rows = events.select("user_id", "event_type", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("second"),
                         F.col(id_col).alias("id"))
    groups = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("count")).where(F.col("count") > 1)
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("id"))).where(F.col("place") <= n)
    same = F.lit(True)
    for c in key:
        same = same & F.col(f"few.{c}").eqNullSafe(F.col(f"groups.{c}"))
    return few.alias("few").join(groups.alias("groups"), same).groupBy(*[F.col(f"groups.{c}").alias(c) for c in key], "count").agg(
        F.array_sort(F.collect_list("id")).alias("sample_ids"))


def sample_documents(events: DataFrame, n: int = 20, id_col: str = "event_id") -> DataFrame:
    """DQ8 samples: the first ``n`` events by id, with the columns the report shows."""
    shown = [c for c in (id_col, "user_id", "event_type", "timestamp", "subscription_tier") if c in events.columns]
    return sample(events, n, id_col).select(*shown)


def timestamp_range(events: DataFrame) -> DataFrame:
    """DQ3: first and last event time, whole days between them, event count."""
    return events.agg(
        F.min("timestamp").alias("min_date"),
        F.max("timestamp").alias("max_date"),
        F.count(F.lit(1)).alias("total_events"),
    ).select("min_date", "max_date",
             F.floor((F.unix_micros(F.col("max_date").cast("timestamp"))
                      - F.unix_micros(F.col("min_date").cast("timestamp"))) / F.lit(86_400_000_000))
             .cast("bigint").alias("date_range_days"),
             "total_events")


def _distribution(events: DataFrame, key: str, limit: int | None) -> DataFrame:
    counts = events.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    total = events.agg(F.count(F.lit(1))).scalar()  # scalar subquery, computed once
    out = counts.select(key, "count", _pct(F.col("count"), total).alias("percentage"))
    out = out.orderBy(F.col("count").desc(), F.col(key).asc_nulls_first())
    return out.limit(limit) if limit else out


def event_type_distribution(events: DataFrame, limit: int = 50) -> DataFrame:
    """DQ4: event types by count (top ``limit``), with share of all events."""
    return _distribution(events, "event_type", limit)


def tier_distribution(events: DataFrame) -> DataFrame:
    """DQ5: subscription tiers by count, with share of all events."""
    return _distribution(events, "subscription_tier", None)


def null_like_counts(events: DataFrame) -> DataFrame:
    """DQ6: per field, values that are NULL, '' or 'null' (whole table; the
    reference looked at a 100-row sample). Only fields with hits."""
    fields = []
    for name, dtype in events.dtypes:
        if dtype.startswith("struct"):
            sub = events.select(f"{name}.*").dtypes
            fields += [(f"{name}.{s}", t) for s, t in sub]
        else:
            fields.append((name, dtype))
    aggs = []
    for name, dtype in fields:
        c = F.col(name)
        cond = c.isNull()
        if dtype == "string":
            cond = cond | c.isin(*NULL_LIKE_TEXT)
        aggs.append(F.count_if(cond).alias(name.replace(".", "__")))
    wide = events.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n.replace('.', '__')}`" for n, _ in fields)
    long = wide.select(F.expr(f"stack({len(fields)}, {stack}) AS (field, count)"))
    return long.where(F.col("count") > 0).select("field", F.col("count").cast("bigint").alias("count"))


def duration_stats(events: DataFrame, col: str = "properties.duration_seconds") -> DataFrame:
    """DQ7: minimum, maximum and mean duration."""
    d = F.col(col).cast("double")
    return events.agg(F.min(d).alias("min_duration"), F.max(d).alias("max_duration"),
                      F.round(F.avg(d.cast("decimal(38,9)")).cast("double"), 6).alias("avg_duration"))


def unexpected_values(events: DataFrame, expected_events: Sequence[str] = EXPECTED_EVENTS,
                      expected_tiers: Sequence[str] = EXPECTED_TIERS) -> DataFrame:
    """DQ9: events whose type / tier is outside the expected sets; NULL counts
    as unexpected (the document store's ``$nin`` matches missing values)."""
    bad_e = ~F.coalesce(F.col("event_type").isin(*expected_events), F.lit(False))
    bad_t = ~F.coalesce(F.col("subscription_tier").isin(*expected_tiers), F.lit(False))
    return events.agg(F.count_if(bad_e).alias("invalid_event_types"),
                      F.count_if(bad_t).alias("invalid_tiers"))


def quality_report(events: DataFrame, expected_events: Sequence[str] = EXPECTED_EVENTS,
                   expected_tiers: Sequence[str] = EXPECTED_TIERS, top_event_types: int = 50) -> DataFrame:
    """DQ8: every check above in one long table (section, key, metric,
    value, text). Each part is a small aggregate; the union is tiny."""
    def row(section, key, metric, value=None, text=None):
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"),
                        F.lit(metric).alias("metric"),
                        (value.cast("double") if value is not None else F.lit(None).cast("double")).alias("value"),
                        (text.cast("string") if text is not None else F.lit(None).cast("string")).alias("text"))

    def explode_rows(df, *rows):
        return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")

    mv = missing_values(events)
    parts = [
        explode_rows(mv, row("missing", F.col("field"), "count", F.col("count")),
                     row("missing", F.col("field"), "percentage", F.col("percentage"))),
        duplicate_groups(events).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit("duplicates").alias("section"), F.lit(None).cast("string").alias("key"),
            F.lit("duplicate_patterns_found").alias("metric"), F.col("n").cast("double").alias("value"),
            F.lit(None).cast("string").alias("text")),
        explode_rows(timestamp_range(events),
                     row("timestamps", F.lit(None), "min_date",
                         text=F.date_format("min_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
                     row("timestamps", F.lit(None), "max_date",
                         text=F.date_format("max_date", "yyyy-MM-dd HH:mm:ss.SSSSSS")),
                     row("timestamps", F.lit(None), "date_range_days", F.col("date_range_days")),
                     row("timestamps", F.lit(None), "total_events", F.col("total_events"))),
        explode_rows(event_type_distribution(events, top_event_types),
                     row("event_types", F.col("event_type"), "count", F.col("count")),
                     row("event_types", F.col("event_type"), "percentage", F.col("percentage"))),
        explode_rows(tier_distribution(events),
                     row("tiers", F.col("subscription_tier"), "count", F.col("count")),
                     row("tiers", F.col("subscription_tier"), "percentage", F.col("percentage"))),
        explode_rows(null_like_counts(events), row("null_like", F.col("field"), "count", F.col("count"))),
        explode_rows(duration_stats(events),
                     row("duration", F.lit(None), "min_duration", F.col("min_duration")),
                     row("duration", F.lit(None), "max_duration", F.col("max_duration")),
                     row("duration", F.lit(None), "avg_duration", F.col("avg_duration"))),
        explode_rows(unexpected_values(events, expected_events, expected_tiers),
                     row("consistency", F.lit(None), "invalid_event_types", F.col("invalid_event_types")),
                     row("consistency", F.lit(None), "invalid_tiers", F.col("invalid_tiers"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
