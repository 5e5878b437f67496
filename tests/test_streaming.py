"""Incremental runs append only final days and drop late data."""

import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlight.streaming.daily_activity import run_available_now

SCHEMA = "event_id long, user_id long, event_type string, feature_name string, timestamp timestamp_ntz"


def _write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(path)


def test_incremental_runs(spark, scratch):
    src, sink, ckpt = (os.path.join(scratch, x) for x in ("src", "sink", "ckpt"))
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    # batch 1: days 1-5, two users on day 1 (one of them twice)
    _write(spark, src, [(1, 1, "view", "f", day(1)), (2, 1, "view", "f", day(1, 18)), (3, 2, "view", "f", day(1)),
                        (4, 1, "view", "f", day(3)), (5, 3, "view", "f", day(5))])
    schema = spark.read.parquet(src).schema
    first = run_available_now(spark, src, schema, lambda d: d, sink_path=sink, checkpoint=ckpt)
    got = {(r.day, r.active_users) for r in first.collect()}
    # watermark = day 5 - 2 days: days 1 and 2 are final, day 3 is not yet
    assert got == {(dt.date(2024, 1, 1), 2)}
    # batch 2: later days plus a late event for day 1 (behind the watermark)
    _write(spark, src, [(6, 4, "view", "f", day(1, 20)), (7, 5, "view", "f", day(8))])
    second = run_available_now(spark, src, schema, lambda d: d, sink_path=sink, checkpoint=ckpt)
    got = {(r.day, r.active_users) for r in second.collect()}
    assert got == {(dt.date(2024, 1, 1), 2), (dt.date(2024, 1, 3), 1), (dt.date(2024, 1, 5), 1)}
