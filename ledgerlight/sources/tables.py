"""Scans with projection and predicate, time-bounded event scans,
deterministic samples and (conditional) counts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.sources.event_days import time_bounds


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               predicate: Column | str | None = None, fmt: str = "parquet") -> DataFrame:
    """Read a table keeping only ``columns`` and rows matching
    ``predicate``; both reach the scan (ReadSchema / PushedFilters)."""
    df = spark.read.format(fmt).load(path)
    if predicate is not None:
        df = df.where(predicate)
    if columns:
        df = df.select(*columns)
    return df


def read_events(spark: SparkSession, path: str, since: dt.datetime | None = None,
                ts_col: str = "timestamp", drop: Sequence[str] = ("_id",), fmt: str = "parquet") -> DataFrame:
    """Events from ``since`` on, without store-internal columns. The
    predicate is on the raw column so parquet row groups can be skipped; a
    table laid out by day (``event_days``) reads only the folders it needs."""
    df = spark.read.format(fmt).load(path)
    if since is not None:
        df = time_bounds(df, F.lit(since.isoformat(sep=" ")).cast(dict(df.dtypes)[ts_col]), ts_col=ts_col)
    return df.drop(*[c for c in drop if c in df.columns])


def sample(df: DataFrame, n: int, order_by: Sequence[str] | str = "event_id") -> DataFrame:
    """The first ``n`` rows in a fixed order (deterministic top-n, planned
    as TakeOrderedAndProject: each task keeps n rows)."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*cols).limit(n)


def row_counts(df: DataFrame, predicates: dict[str, Column] | None = None) -> DataFrame:
    """Total rows and the rows matching each named predicate, in one
    aggregation pass."""
    aggs = [F.count(F.lit(1)).alias("total")]
    for name, p in (predicates or {}).items():
        aggs.append(F.count_if(p).alias(name))
    return df.agg(*aggs)
