"""DB14 kept up to date: monthly summaries that a new delivery changes only
where it has rows.

Counts and sums merge by addition; distinct users do not, so their sets are kept
as bitmaps. Every user has a dense number, given once, and a summary row's users
are one bitmap of 4 KB for each 32,768 numbers it has any of. A delivery adds
its own partial rows (``state/batch=N/month=M``); the months it touches are
summed anew from the partial rows of all deliveries, others are left alone,
and the summary is published as a whole (``sources.versions``). A delivery that
is added again under its number replaces its own rows, so it counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ledgerlight.session import materialize
from ledgerlight.sources.keyed import KeyedTable
from ledgerlight.sources.versions import VersionedTable

_ID_BITS = 33   # monotonically_increasing_id: the task above, the row below


class MonthlySummary:
    """``keys`` beside the month, named ``sums`` of expressions over the rows,
    and the exact number of distinct ``user_col`` (as ``users``)."""

    def __init__(self, spark: SparkSession, base: str, time_col: str, sums: dict[str, Column], keys: Sequence[str] = (),
                 user_col: str = "user_id"):
        self.spark, self.base, self.time_col = spark, base.rstrip("/"), time_col
        self.keys, self.sums, self.user_col = ["month", *keys], sums, user_col
        self.table = VersionedTable(spark, f"{self.base}/summary")

    def _number_users(self, rows: DataFrame) -> KeyedTable:
        """Give every user of ``rows`` that has none a number, on from the
        highest, in the order of the tasks that hold them. Numbers stay, also
        those of a delivery that failed later on. Only the delivery's users are
        shuffled: the known ones lie in buckets."""
        fresh = rows.select(F.col(self.user_col).alias("user")).where("user is not null").distinct()
        users = KeyedTable(self.spark, f"{self.base}/users", "user",
                           StructType([fresh.schema["user"], StructField("number", LongType())]))
        first = (users.read().agg(F.max("number")).first()[0] or 0) + 1
        fresh = fresh.join(users.read().select("user").hint("merge"), "user", "left_anti")
        fresh = materialize(fresh.withColumn("row", F.monotonically_increasing_id()))
        task = F.shiftright("row", _ID_BITS)
        sizes = fresh.groupBy(task.alias("task")).count()      # one row per task
        starts = sizes.select("task", (F.sum("count").over(Window.orderBy("task")) - F.col("count") + first).alias("start"))
        users.insert(fresh.withColumn("task", task).join(F.broadcast(starts), "task").select(
            "user", (F.col("start") + F.col("row").bitwiseAND(F.lit((1 << _ID_BITS) - 1))).alias("number")))
        return users

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Merge delivery ``batch`` and return the summary with it."""
        newest = self.table.manifest()
        if newest and batch <= int(newest.action.split()[1]):
            return self.table.read()
        rows = rows.withColumn("month", F.trunc(F.to_date(self.time_col), "month"))
        # one row per user and key before anything is joined: a busy user is one row
        per_user = rows.groupBy(*self.keys, F.col(self.user_col).alias("user")).agg(
            *[F.sum(c).alias(name) for name, c in self.sums.items()])
        per_user = materialize(per_user)
        users = self._number_users(per_user.withColumnRenamed("user", self.user_col))
        part = per_user.join(users.read().hint("merge"), "user", "left").groupBy(*self.keys, F.expr("bitmap_bucket_number(number)").alias("bucket")).agg(
            F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits"),
            *[F.sum(name).alias(name) for name in self.sums])
        part = part.withColumn("m", F.col("month"))
        mine = f"{self.base}/state/batch={batch}"
        part.write.mode("overwrite").partitionBy("m").parquet(mine)
        users.close()
        # months are bounded by the calendar
        months = [r[0] for r in self.spark.read.schema(part.schema).parquet(mine).select("m").distinct().collect()]
        touched = F.col("m").isin([m for m in months if m is not None]) | (F.col("m").isNull() if None in months else F.lit(False))
        state = self.spark.read.schema(StructType([*part.schema.fields, StructField("batch", LongType())])) \
            .parquet(f"{self.base}/state").where(F.col("batch") <= batch).where(touched)
        merged = state.groupBy(*self.keys, "bucket").agg(
            F.expr("bitmap_or_agg(bits)").alias("bits"), *[F.sum(name).alias(name) for name in self.sums])
        anew = merged.groupBy(*self.keys).agg(
            *[F.sum(name).alias(name) for name in self.sums], F.sum(F.expr("bitmap_count(bits)")).alias("users"))
        if newest:
            # what the delivery did not touch stays as it is
            old = self.table.read(newest.version)
            anew = old.join(F.broadcast(anew.select("month").distinct().withColumnRenamed("month", "t")),
                            F.col("month").eqNullSafe(F.col("t")), "left_anti").unionByName(anew)
        self.table.publish(anew, f"batch {batch}", expected=newest.version if newest else 0)
        return self.table.read()


def events_by_month(spark: SparkSession, base: str) -> MonthlySummary:
    """Events and distinct users per month and event type."""
    return MonthlySummary(spark, base, "timestamp", {"events": F.lit(1)}, ["event_type"])


def sessions_by_month(spark: SparkSession, base: str) -> MonthlySummary:
    """Sessions, distinct users and the parts of the mean duration per month."""
    return MonthlySummary(spark, base, "start_time", {
        "sessions": F.lit(1), "seconds": F.col("duration"), "timed": F.col("duration").isNotNull().cast("int")})


def session_means(summary: DataFrame) -> DataFrame:
    """The session summary with its mean duration, as ``monthly_session_summary`` gives it."""
    return summary.select("month", "sessions", "users", F.round(F.col("seconds") / F.col("timed"), 4).alias("avg_duration"))
