"""S5 / DB14: events stored in one folder a day.

``write_events`` lays a table out by the day of its timestamp, ``replace_days``
replaces only the days a corrected delivery holds, and ``time_bounds`` gives a
job's time limits to the scan twice: on the timestamp, so that row groups are
skipped, and on the day derived from it, so that other days' folders are not
even listed.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlight.functions.exprs import ts_literal

DAY = "event_date"


def _time(value: Column | dt.datetime) -> Column:
    return value if isinstance(value, Column) else ts_literal(value)


def time_bounds(events: DataFrame, since: Column | dt.datetime | None = None, until: Column | dt.datetime | None = None,
                ts_col: str = "timestamp", day_col: str | None = DAY) -> DataFrame:
    """Events from ``since`` on and before ``until``. Where the frame has the
    day column (written by ``write_events``), the limits on it follow from
    those on the time; no row is lost, as a row's day is that of its time."""
    by_day = day_col is not None and day_col in events.columns
    if since is not None:
        events = events.where(F.col(ts_col) >= _time(since))
        if by_day:
            events = events.where(F.col(day_col) >= F.to_date(_time(since)))
    if until is not None:
        events = events.where(F.col(ts_col) < _time(until))
        if by_day:
            events = events.where(F.col(day_col) <= F.to_date(_time(until)))
    return events


def _by_day(events: DataFrame, ts_col: str) -> DataFrame:
    # one task writes a whole small day, a hot day is split over several
    return events.withColumn(DAY, F.to_date(ts_col)).hint("rebalance", DAY).sortWithinPartitions(DAY, ts_col)


def write_events(events: DataFrame, path: str, ts_col: str = "timestamp", max_records_per_file: int = 5_000_000) -> None:
    """The whole table, one folder a day (replaces what is there). Events
    without a time have a folder of their own."""
    _by_day(events, ts_col).write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file) \
        .option("partitionOverwriteMode", "static").partitionBy(DAY).parquet(path)


def replace_days(events: DataFrame, path: str, ts_col: str = "timestamp", max_records_per_file: int = 5_000_000) -> None:
    """Replace the days that ``events`` holds, and leave all others as they are."""
    _by_day(events, ts_col).write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file) \
        .option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
