"""S8-S10 and DB14 sinks. All writes are distributed (one file per task)
and replace their target atomically per Spark's commit protocol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_result(df: DataFrame, path: str) -> None:
    """A query result as JSON lines (replaces the target)."""
    df.write.mode("overwrite").json(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Merged data as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A report / log frame (long format) as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str], fmt: str = "parquet",
                      max_records_per_file: int = 5_000_000) -> None:
    """DB14 and event layout: a table partitioned by ``partition_cols``
    (e.g. event_date or month) so that date filters prune whole folders.
    Rows are rebalanced by the partition value first: one task writes a whole
    small value (one file instead of one per task), and AQE splits a hot one
    over several tasks. Files end at ``max_records_per_file``."""
    (df.hint("rebalance", *partition_cols).sortWithinPartitions(*partition_cols).write.mode("overwrite")
     .option("maxRecordsPerFile", max_records_per_file).partitionBy(*partition_cols).format(fmt).save(path))
