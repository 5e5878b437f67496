"""The event chain on files as the generator writes them (no event id, text
times), unreadable values, and the t-test against published values."""

import datetime as dt
import math
import os

import pytest
from pyspark.sql import functions as F

from ledgerlight.functions.stats import t_two_sided_p_col
from ledgerlight.plans import cleaning, customer360, quality
from ledgerlight.sources.canonical import canonical_events, canonical_sessions
from ledgerlight.sources.generate import generate, write_csv_dir
from ledgerlight.sources.loader import load_csv_dir


def test_generate_load_clean_profile_merge(spark, scratch):
    csv_dir, out = os.path.join(scratch, "csv"), os.path.join(scratch, "tables")
    write_csv_dir(generate(spark, customers=12, seed=5), csv_dir)
    load_csv_dir(spark, csv_dir, out)
    t = {n: spark.read.parquet(os.path.join(out, n)) for n in
         ("customers", "subscriptions", "plans", "billing", "support_tickets", "events", "sessions")}
    raw = t["events"]
    assert "event_id" not in raw.columns
    clean, report = cleaning.clean_events(raw)
    counts = {r["metric"]: r["value"] for r in report.collect()}
    assert counts["before_total"] == raw.count() and counts["after_total"] == clean.count() > 0
    assert clean.select("event_id").distinct().count() == clean.count()
    profile = quality.quality_report(canonical_events(raw))
    assert profile.where("section = 'missing'").count() > 0
    sessions = canonical_sessions(t["sessions"])
    assert dict(sessions.dtypes)["start_time"] == "timestamp_ntz" and sessions.where("start_time is null").count() == 0
    run = customer360.customer360(t["customers"], t["subscriptions"], t["plans"], t["billing"], t["support_tickets"],
                                  dt.date(2024, 1, 31), clean, sessions, grain="customer")
    assert run.cleaning_log.count() == 5 and run._merged is None
    assert run.merged.count() <= 12 and run.segment_stats.count() > 0


def test_properties_are_kept(spark):
    raw = spark.createDataFrame([("u", "{'session_duration': 5, 'page_views': 3, 'actions': 7}")], "user_id string, properties string")
    p = canonical_events(raw).first()["properties"]
    assert (p["duration_seconds"], p["page_views"], p["actions"]) == (5.0, 3.0, 7.0)


def test_unreadable_times_stay_distinct(spark):
    rows = [("u", "view", t) for t in ("not-a-date", "31/12/2023 10:00", "yesterday", "yesterday", "2024-01-01 00:00:00",
                                       "2024-01-01T00:00:00Z", None, None)]
    raw = spark.createDataFrame(rows, "user_id string, event_type string, timestamp string").withColumn(
        "properties", F.lit("{}")).withColumn("event_id", F.monotonically_increasing_id())
    clean, report = cleaning.clean_events(raw)
    assert sorted(r["timestamp_raw"] for r in cleaning.quarantine(clean).collect()) == ["31/12/2023 10:00", "not-a-date", "yesterday"]
    assert clean.count() == 5
    assert {r["metric"]: r["value"] for r in report.collect()}["duplicates_removed"] == 3


def test_bad_dates_become_null(spark):
    subs = spark.createDataFrame([(1, 7, "pro", "12.5", "2024-01-01", "soon"), (2, 7, "pro", None, "never", None)],
                                 "subscription_id long, customer_id long, tier string, monthly_revenue string, start_date string, end_date string") \
        .withColumn("monthly_revenue", F.col("monthly_revenue").cast("decimal(18,2)"))
    out, _ = cleaning.clean_subscriptions(subs)
    assert [(r.subscription_id, r.start_date, r.end_date) for r in out.collect()] == [(1, dt.date(2024, 1, 1), None)]
    tix = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00", "2024-01-01 02:00:00"), (2, 7, "then", "later")],
                                "ticket_id long, customer_id long, created_at string, resolved_at string")
    out, _ = cleaning.clean_tickets(tix)
    assert sorted((r.ticket_id, r.resolution_time_hours) for r in out.collect()) == [(1, 2.0), (2, None)]


# (t, degrees of freedom, two-sided p) as printed in t tables
TABLE = [(12.706, 1, 0.05), (4.303, 2, 0.05), (2.571, 5, 0.05), (4.032, 5, 0.01), (2.228, 10, 0.05), (3.169, 10, 0.01),
         (2.042, 30, 0.05), (1.96, 10 ** 6, 0.05)]


def test_p_value_against_tables_and_closed_forms(spark):
    rows = [(float(t), float(n), p) for t, n, p in TABLE]
    got = spark.createDataFrame(rows, "t double, n double, p double").select("p", t_two_sided_p_col(F.col("t"), F.col("n")).alias("q")).collect()
    assert all(r["q"] == pytest.approx(r["p"], rel=2e-3) for r in got)
    for t in (0.1, 0.7, 1.5, 4.0, 20.0):
        one = 1 - 2 / math.pi * math.atan(t)
        two = 1 - t / math.sqrt(2 + t * t)
        q = spark.range(1).select(t_two_sided_p_col(F.lit(t), F.lit(1.0)).alias("a"), t_two_sided_p_col(F.lit(-t), F.lit(2.0)).alias("b")).first()
        assert q["a"] == pytest.approx(one, abs=1e-9) and q["b"] == pytest.approx(two, abs=1e-9)


def test_stream_closing_batch_gives_every_day(spark, scratch):
    from ledgerlight.streaming.daily_activity import run_available_now, with_open_days
    src = os.path.join(scratch, "src")
    rows = [(1, "view", "f", dt.datetime(2024, 1, d, 12)) for d in range(1, 8)] + [(2, "view", "f", dt.datetime(2024, 1, 7, 1))]
    spark.createDataFrame(rows, "user_id long, event_type string, feature_name string, timestamp timestamp_ntz").write.parquet(src)
    events = spark.read.parquet(src)
    final = run_available_now(spark, src, events.schema, lambda d: d)
    got = sorted((r.day.day, r.active_users) for r in with_open_days(final, events).collect())
    assert got == [(d, 1) for d in range(1, 7)] + [(7, 2)]
