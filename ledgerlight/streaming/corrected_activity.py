"""R1 with corrections: daily active users per feature, late events included.

``daily_activity`` appends a day once its watermark has passed and drops what
comes later. Here nothing is dropped. Every micro-batch

1. takes its (user, feature, day) rows that no earlier batch had, by an
   anti-join with the stored rows of the same days, and stores them below its
   own number (``seen/batch=N/day=D``);
2. puts those whose day was already closed (more than ``closed_after`` days
   before the latest day of the earlier batches) into a side table, so that late
   arrivals can be counted and looked at;
3. merges its counts by (day, feature) into the published series and publishes
   that as a new version (``sources.versions``): readers see a whole batch or
   nothing of it.

A batch that is run again after a failure writes the same rows to the same
place, and is not merged twice: the version names the last batch in it. The
stored rows are partitioned by day, so a batch reads the days it touches only;
the series has one row per day and feature.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlight.sources.loader import path_exists
from ledgerlight.sources.versions import VersionedTable

SERIES = "day date, feature_name string, active_users bigint, late_users bigint"


class CorrectedActivity:
    """The series kept below ``base``. ``active_users`` counts every distinct
    user of a day and feature, ``late_users`` those of them that first came
    after the day was closed."""

    def __init__(self, spark: SparkSession, base: str, closed_after: int = 2, feature_events: Sequence[str] | None = None):
        self.spark, self.base = spark, base.rstrip("/")
        self.closed_after, self.feature_events = closed_after, feature_events
        self.table = VersionedTable(spark, f"{self.base}/series")

    def _stored(self, name: str, schema: str) -> DataFrame:
        """The stored rows of all batches of a side table."""
        path = f"{self.base}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def seen(self, user_type: str) -> DataFrame:
        return self._stored("seen", f"user_id {user_type}, feature_name string, batch bigint, day date")

    def late(self, user_type: str = "bigint") -> DataFrame:
        """Every (user, feature, day) that came after its day was closed, and
        the batch it came in."""
        return self._stored("late", f"user_id {user_type}, feature_name string, day date, batch bigint")

    def last_batch(self) -> int:
        """The last batch in the published series, -1 before the first."""
        newest = self.table.manifest()
        return int(newest.action.split()[1]) if newest else -1

    def apply(self, events: DataFrame, batch: int) -> None:
        """Merge one micro-batch of canonical events (``foreachBatch``)."""
        if batch <= self.last_batch():
            return
        e = events.where("feature_name is not null and user_id is not null and timestamp is not null")
        if self.feature_events:
            e = e.where(F.col("event_type").isin(list(self.feature_events)))
        rows = e.select("user_id", "feature_name", F.to_date("timestamp").alias("day")).distinct()
        before = self.seen(dict(rows.dtypes)["user_id"]).where(F.col("batch") < batch)
        # days are bounded by the calendar, whatever the number of events
        days = [r[0] for r in rows.select("day").distinct().collect()]
        base = self.table.manifest()
        # every earlier batch is in the series, a row for each day and feature
        latest = self.table.read(base.version).agg(F.max("day")).first()[0] if base else None
        closed = F.lit(False) if latest is None else F.col("day") < F.date_sub(F.lit(latest), self.closed_after)
        fresh = rows.join(before.where(F.col("day").isin(days)), ["user_id", "feature_name", "day"], "left_anti")
        mine = f"{self.base}/seen/batch={batch}"
        fresh.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(mine)
        stored = self.spark.read.schema(f"user_id {dict(rows.dtypes)['user_id']}, feature_name string, day date").parquet(mine)
        if latest is not None:
            stored.where(closed).write.mode("overwrite").parquet(f"{self.base}/late/batch={batch}")
        added = stored.groupBy("day", "feature_name").agg(
            F.count(F.lit(1)).alias("active_users"), F.count_if(closed).alias("late_users"))
        series = added if base is None else self.table.read(base.version).unionByName(added) \
            .groupBy("day", "feature_name").agg(F.sum("active_users").alias("active_users"), F.sum("late_users").alias("late_users"))
        self.table.publish(series, f"batch {batch}", expected=base.version if base else 0)

    def run(self, source_path: str, schema: StructType, prepare: Callable[[DataFrame], DataFrame],
            max_files_per_trigger: int | None = None) -> DataFrame:
        """Process every file that has come to ``source_path`` since the last
        run (trigger availableNow) and return the published series."""
        reader = self.spark.readStream.schema(schema)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        query = (prepare(reader.parquet(source_path)).writeStream.foreachBatch(self.apply)
                 .option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        return self.series()

    def series(self) -> DataFrame:
        if self.table.manifest() is None:
            return self.spark.createDataFrame([], SERIES)
        return self.table.read()
