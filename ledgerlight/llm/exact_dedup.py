"""Exact duplicates through a persistent digest index (DataFrame operations only).

The index is a table of (digest, keep_id, group_size), bucketed and sorted by
digest on shared storage. A batch is reduced to one row per digest before
anything is shuffled by digest. Digests that a sort-merge anti-join against the
index finds new are appended with their keep_id, known ones with their count in
the batch only; reading sums the counts. So ``group_size`` is the number of rows
of all batches up to this one; what an earlier batch returned is not changed.

Defined cases. Null text counts as empty; empty texts are one group. Rows that
repeat a doc_id stay separate rows and count separately in ``group_size``. A
null doc_id is kept only if its group has no other id. An empty batch appends
nothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlight.llm.common import ascii_lower, scratch_path, stored, text_or_empty


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z lower-cased."""
    return docs.select("doc_id", F.sha2(ascii_lower(text_or_empty()), 256).alias("digest"))


class DigestIndex:
    """Known digests, bucketed and sorted by digest in one table; one row per
    digest and batch."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "digests")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex[:12]}"
        spark.sql(f"CREATE TABLE {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
                  f"LOCATION '{self.path}'")

    def add(self, batch: DataFrame) -> None:
        """Append the digests of ``batch`` (doc_id, digest): those the index lacks
        with their keep_id, the others with their count alone."""
        # a table of its own: else the optimiser moves the anti-join below the
        # aggregate, and every copy is shuffled by its digest
        groups = stored(batch.groupBy("digest").agg(
            F.max("doc_id").cast("long").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        known = self.spark.table(self.table).select("digest")
        new = groups.join(known.hint("merge"), "digest", "left_anti")
        grown = groups.join(known.distinct().hint("merge"), "digest", "left_semi") \
            .withColumn("keep_id", F.lit(None).cast("long"))
        new.unionByName(grown).write.format("parquet").mode("append").bucketBy(self.buckets, "digest") \
            .sortBy("digest").option("path", self.path).saveAsTable(self.table)

    def rows(self) -> DataFrame:
        """The whole index, one row per digest, as plain files (a join may then
        split a hot digest)."""
        return stored(self.spark.table(self.table).groupBy("digest").agg(
            F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "index")


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts (A-Z lower-cased) of the batch the largest doc_id stays,
    unless ``index`` knew the text before: then the known row stays.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    batch = digests(docs)
    index.add(batch)
    return batch.join(index.rows().hint("merge"), "digest").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every row and whole text of ``documents`` through a new index."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
