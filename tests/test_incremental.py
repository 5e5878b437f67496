"""Tables that grow: days replaced in place, late events, summaries by delivery,
and the ordered funnel from segments."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.plans import events as event_jobs
from ledgerlight.plans import summaries
from ledgerlight.plans.datasets import monthly_event_summary, monthly_session_summary
from ledgerlight.sources import event_days
from ledgerlight.sources.tables import read_events
from ledgerlight.streaming.corrected_activity import CorrectedActivity

SCHEMA = "event_id long, user_id long, event_type string, feature_name string, timestamp timestamp_ntz"
STAGES = ("signup", "view", "click", "purchase")


def at(day, hour=12, month=1):
    return dt.datetime(2024, month, day, hour)


def some_events(n, users=30, seed=1, hot=0.3):
    rng = random.Random(seed)
    kinds = [*STAGES, "error", None]
    return [(i, None if rng.random() < 0.02 else 0 if rng.random() < hot else rng.randrange(1, users), rng.choice(kinds),
             rng.choice(["f", "g", None]), None if rng.random() < 0.02 else
             dt.datetime(2024, rng.randrange(1, 4), rng.randrange(1, 28), rng.randrange(24), rng.choice([0, 30])))
            for i in range(n)]


# ---------------------------------------------------------------- days

def test_days_prune_folders_and_are_replaced(spark, scratch):
    path = os.path.join(scratch, "events")
    rows = [(i, 1, "view", "f", at(1 + i % 9, i % 24)) for i in range(90)] + [(99, 1, "view", "f", None)]
    events = spark.createDataFrame(rows, SCHEMA)
    event_days.write_events(events, path)
    got = read_events(spark, path, since=at(6, 7))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "event_date" in plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp," in plan
    want = sorted(r[0] for r in rows if r[4] and r[4] >= at(6, 7))
    assert sorted(r.event_id for r in got.collect()) == want
    day = {n: os.path.getmtime(os.path.join(path, n)) for n in os.listdir(path) if n.startswith("event_date=")}
    event_days.replace_days(spark.createDataFrame([(500, 2, "click", "g", at(3))], SCHEMA), path)
    back = spark.read.parquet(path)
    assert [r.event_id for r in back.where("event_date = date'2024-01-03'").collect()] == [500]
    assert back.count() == len(rows) - 10 + 1 and back.where("event_date is null").count() == 1
    same = [n for n in day if os.path.getmtime(os.path.join(path, n)) == day[n]]
    assert len(same) == len(day) - 1


def test_event_jobs_prune_folders(spark, scratch):
    path = os.path.join(scratch, "events")
    event_days.write_events(spark.createDataFrame(some_events(300), SCHEMA).withColumn("subscription_tier", F.lit("free"))
                            .withColumn("properties", F.struct(F.lit(1.0).alias("duration_seconds"))), path)
    events = spark.read.parquet(path)
    as_of = dt.datetime(2024, 3, 20)
    for job in (event_jobs.active_days(events, as_of, 7, ["view"]), event_jobs.engaged_users(events, as_of, days_back=9),
                event_jobs.funnel(events, STAGES, since=at(2), until=at(5))):
        plan = job._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(event_date" in plan


# ---------------------------------------------------------------- late events

def test_late_events_equal_the_batch(spark, scratch):
    rows = some_events(600, seed=4)
    source = os.path.join(scratch, "source")
    job = CorrectedActivity(spark, os.path.join(scratch, "job"), closed_after=2)
    assert job.series().collect() == []
    early = [r for r in rows if r[0] % 3]
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    frame(early).write.parquet(source)
    schema = frame(rows).schema
    first = job.run(source, schema, lambda d: d)
    keys = lambda part: {(r[4].date(), r[3], r[1]) for r in part if None not in (r[1], r[3], r[4])}

    def series(part, late=frozenset()):
        return {(d, f, len({u for a, b, u in keys(part) if (a, b) == (d, f)}), sum((a, b) == (d, f) for a, b, _ in late))
                for d, f, _ in keys(part)}

    assert {tuple(r) for r in first.collect()} == series(early)
    pinned = job.series()
    frame([r for r in rows if not r[0] % 3]).write.mode("append").parquet(source)
    second = job.run(source, schema, lambda d: d)
    closed = max(k[0] for k in keys(early)) - dt.timedelta(days=2)
    late = {k for k in keys(rows) - keys(early) if k[0] < closed}
    assert late and {tuple(r) for r in second.collect()} == series(rows, late)
    assert {(r.day, r.feature_name, r.user_id) for r in job.late().collect()} == late
    assert {tuple(r) for r in pinned.collect()} == series(early)
    # a run without new files, and a batch that comes again, change nothing
    job.run(source, schema, lambda d: d)
    job.apply(frame(rows), 1)
    assert job.table.versions() == [1, 2]


def test_batch_repeated_before_it_was_published(spark, scratch, monkeypatch):
    rows = some_events(200, seed=6)
    job = CorrectedActivity(spark, os.path.join(scratch, "job"))
    frame = spark.createDataFrame(rows, SCHEMA)
    job.apply(frame.where("event_id < 100"), 0)
    publish = job.table.publish
    monkeypatch.setattr(job.table, "publish", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        job.apply(frame.where("event_id >= 100"), 1)
    monkeypatch.setattr(job.table, "publish", publish)
    job.apply(frame.where("event_id >= 100"), 1)
    whole = CorrectedActivity(spark, os.path.join(scratch, "whole"))
    whole.apply(frame, 0)
    pick = ["day", "feature_name", "active_users"]
    assert sorted(map(tuple, job.series().select(*pick).collect())) == sorted(map(tuple, whole.series().select(*pick).collect()))


# ---------------------------------------------------------------- summaries

def test_three_deliveries_equal_one_run(spark, scratch):
    events = spark.createDataFrame(some_events(900, users=200, seed=8), SCHEMA).withColumn("user_id", F.concat(F.lit("u"), "user_id"))
    job = summaries.events_by_month(spark, os.path.join(scratch, "m"))
    want = lambda df: sorted(map(str, monthly_event_summary(df).select("month", "event_type", "events", "users").collect()))
    got = lambda df: sorted(map(str, df.select("month", "event_type", "events", "users").collect()))
    assert got(job.add(events.where("event_id < 300"), 0)) == want(events.where("event_id < 300"))
    job.add(events.where("event_id between 300 and 599"), 1)
    assert got(job.add(events.where("event_id >= 600"), 2)) == want(events)
    assert got(job.add(events.where("event_id >= 600"), 2)) == want(events)     # the same delivery again
    numbers = spark.read.parquet(os.path.join(scratch, "m", "users"))
    assert numbers.count() == numbers.select("number").distinct().count() == numbers.agg(F.max("number")).first()[0]
    # a delivery of one month sums that month's partial rows only
    assert got(job.add(events.where("1 = 0"), 3)) == want(events)
    assert job.table.versions() == [1, 2, 3, 4]


def test_interrupted_delivery_and_sessions(spark, scratch):
    rows = [(i, 40_000 * (i % 7) + i % 3, at(1 + i % 20, month=1 + i % 3), None if i % 5 == 0 else i) for i in range(100)]
    sessions = spark.createDataFrame(rows, "session_id long, user_id long, start_time timestamp_ntz, duration long")
    job = summaries.sessions_by_month(spark, os.path.join(scratch, "s"))
    job.add(sessions.where("session_id < 50"), 0)
    publish = job.table.publish
    job.table.publish = lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        job.add(sessions.where("session_id >= 50"), 1)
    job.table.publish = publish
    got = summaries.session_means(job.add(sessions.where("session_id >= 50"), 1))
    assert sorted(map(tuple, got.collect())) == sorted(
        map(tuple, monthly_session_summary(sessions).select("month", "sessions", "users", "avg_duration").collect()))


# ---------------------------------------------------------------- ordered funnel

def slow_funnel(rows, stages):
    """(users, sorted gaps) of every stage, user by user."""
    reached = [[] for _ in stages]
    for user in {r[1] for r in rows if r[1] is not None}:
        mine, t = [(r[4], r[2]) for r in rows if r[1] == user and r[4] is not None], None
        for k, stage in enumerate(stages):
            hits = [x for x, kind in mine if kind == stage and (t is None or x >= t)]
            if not hits:
                break
            reached[k].append(None if t is None else (min(hits) - t).total_seconds())
            t = min(hits)
    return reached


@pytest.mark.parametrize("stages", [STAGES, ("view", "error"), ("purchase", "click", "signup", "view", "error")])
def test_ordered_funnel_by_brute_force(spark, stages):
    rows = some_events(700, users=60, seed=len(stages))
    events = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = event_jobs.funnel(events, stages, ordered=True).collect()
    for row, reached in zip(got, slow_funnel(rows, stages)):
        assert row["count"] == len(reached)
        gaps = sorted(g for g in reached if g is not None)
        if gaps:
            middle = (gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2
            assert abs(row["median_seconds_from_prev"] - middle) < 1e-3


def test_hot_user_stays_split(spark):
    rows = [(i, 0 if i % 3 == 0 else i, STAGES[i % 4], "f", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)) for i in range(6000)]
    events = spark.createDataFrame(rows, SCHEMA)
    parts = event_jobs.funnel_segments(events, STAGES, partitions=12).groupBy("user_id").count()
    assert parts.where("user_id = 0").first()["count"] >= 4
    assert parts.agg(F.max("count")).first()[0] <= 12


def test_ordered_funnel_reads_events_once(spark, monkeypatch):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    import __spark_entry__ as entry
    from plan_report import record_stored_plans
    stored = record_stored_plans(monkeypatch.setattr)
    df = entry.queries()["onboarding_funnel_ordered"](spark, "/root/testdata/sf0.001")
    plans = "\n".join([*stored, df._jdf.queryExecution().executedPlan().toString()])
    assert plans.count("events.parquet") <= 2 and "SortMergeJoin [user_id" not in plans
