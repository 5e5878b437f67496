"""Helpers shared by the corpus operators: tables on shared storage, column
clean-up, and distributed connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_SCRATCH: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session that names none (tests) gets a folder of its own; on
    a cluster a missing setting is an error, as a folder of one machine is not
    visible to the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="ledgerlight-llm-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path on shared storage."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once to shared storage and read it back: lineage ends
    there, every later pass reads only the columns it needs, and the loss of
    an executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that nothing
    refers to any more. It acts when the driver's JVM collects its garbage,
    which an idle driver may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the built-in fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph by distributed union-find
    (alternating large-star and small-star rounds).

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; nodes
    that touch no edge are not in the result. Every round is one aggregation
    with map-side combine and one equi-join, so a hub of any degree is never
    gathered in one task, and each round's result is a table on shared
    storage. Returns (node, component) with component = smallest node.
    Self-loops, repeated and reversed edges, and nulls (ignored) are fine.
    """
    spark = edges.sparkSession
    star = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    star = stored(star, "cc")
    previous = None
    for _ in range(max_rounds):
        # large star: neighbours above u hook onto u's smallest neighbour
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours at or below u, and u itself, hook onto the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        star = stored(small, "cc")
        sign = star.agg(F.count("u").alias("n"), F.countDistinct("u").alias("d"),
                        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        # every node has exactly one parent and nothing changed: all are stars
        if (sign["n"], sign["h"]) == previous or sign["n"] == 0:
            break
        previous = (sign["n"], sign["h"])
    else:
        raise RuntimeError("connected components did not converge")
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        star.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
