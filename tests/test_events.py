"""Micro-tables for the event jobs."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerlight.plans import events as ev

EV = ("event_id long, user_id long, customer_id long, event_type string, feature_name string, "
      "subscription_tier string, timestamp timestamp_ntz, properties struct<duration_seconds:double>")
AS_OF = dt.datetime(2024, 1, 31)


def _ev(spark, rows):
    return spark.createDataFrame(rows, EV)


def test_funnel_rates(spark):
    rows, i = [], 0
    for stage, users in (("a", 10), ("b", 8)):
        for u in range(users):
            rows.append((i, u, u, stage, None, "free", dt.datetime(2024, 1, 5), (1.0,)))
            i += 1
    out = ev.funnel(_ev(spark, rows), ("a", "b", "c", "d")).collect()
    assert [r["count"] for r in out] == [10, 8, 0, 0]
    assert [r.conversionRate for r in out] == [1.0, 0.8, 0.0, 0.0]
    assert [r.dropOffRate for r in out] == [0.0, 0.2, 1.0, 1.0]


def test_ordered_funnel_is_non_increasing(spark):
    rows = [(1, 1, 1, "a", None, "free", dt.datetime(2024, 1, 5, 10), (1.0,)),
            (2, 1, 1, "b", None, "free", dt.datetime(2024, 1, 5, 11), (1.0,)),
            (3, 2, 2, "b", None, "free", dt.datetime(2024, 1, 5, 9), (1.0,)),   # b before a: not in order
            (4, 2, 2, "a", None, "free", dt.datetime(2024, 1, 5, 10), (1.0,)),
            (5, 3, 3, "b", None, "free", dt.datetime(2024, 1, 5, 12), (1.0,))]
    out = ev.funnel(_ev(spark, rows), ("a", "b"), ordered=True).collect()
    assert [r["count"] for r in out] == [2, 1]
    assert out[1].median_seconds_from_prev == 3600.0


def test_retention_horizon(spark):
    def act(uid, *days):
        return [(uid * 100 + k, uid, uid, "feature_use", "f", "pro", dt.datetime(2024, 1, d, 12), (1.0,))
                for k, d in enumerate(days)]
    rows = act(1, 1) + act(2, 1, 8) + act(3, 1, 9)
    r = ev.feature_dau_retention(_ev(spark, rows), AS_OF, 60).first()
    assert r.retention7Day == round(1 / 3, 3)


def test_engaged_users(spark):
    rows = [(i, 5, 5, "x", f"feat{i % 10}", "free", dt.datetime(2024, 1, 22), (300.0,)) for i in range(250)]
    r = ev.engaged_users(_ev(spark, rows), AS_OF).first()
    assert r.engagementScore == 0.6 and r.potentialValue == "Medium" and r.potentialArpu == 80 * 250
    assert r.metrics.daysSinceLastActive == 9.0


def test_retention_mature_only(spark):
    def act(uid, *days):
        return [(uid * 100 + k, uid, uid, "feature_use", "f", "pro", dt.datetime(2024, 1, d, 12), (1.0,))
                for k, d in enumerate(days)]
    # user 1: d0 = Jan 10, back on Jan 12 (mature cohort); user 2: d0 = Jan 28 (horizon ends after as_of)
    days = ev.active_days(_ev(spark, act(1, 10, 12) + act(2, 28)), AS_OF, 60, ("feature_use",))
    allc = ev.retention(days, AS_OF).first()
    mature = ev.retention(days, AS_OF, mature_only=True).first()
    assert (allc.cohort_users, allc.retained_users, allc.retention) == (2, 1, 0.5)
    assert (mature.cohort_users, mature.retained_users, mature.retention) == (1, 1, 1.0)
