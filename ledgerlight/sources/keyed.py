"""S1 with primary keys: tables that take a key's first row and refuse the rest.

The table is bucketed and sorted by its key, so it is its own index: a delivery
is joined with the table's key column alone, bucket by bucket, and only the
delivery is shuffled. Its own repeated keys are reduced to one row before that.
Rows whose key is there already, and rows without one, add nothing, whether the
same file comes again or a file that overlaps with an older one.

An append becomes visible as a whole (Spark's commit of the job), so a load that
dies adds nothing and can be run again. The number of buckets is kept beside the
table; a session that opens the path finds it there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ABOUT = "_keyed.json"


class KeyedTable:
    """The table at ``path`` with the primary ``key`` columns. ``buckets`` and
    ``schema`` matter only when it is made; by default there are as many buckets as
    the session has shuffle partitions. It is known to this session's catalog
    under a name of its own until ``close``; the files stay."""

    def __init__(self, spark: SparkSession, path: str, key: str | Sequence[str], schema: StructType | None = None,
                 buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.key = [key] if isinstance(key, str) else list(key)
        jvm = spark.sparkContext._jvm
        about = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{ABOUT}")
        fs = about.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(about):
            stream = fs.open(about)
            try:
                told = json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, jvm.java.nio.charset.StandardCharsets.UTF_8))
            finally:
                stream.close()
            if told["key"] != self.key:
                raise ValueError(f"{self.path} has the key {told['key']}, not {self.key}")
        elif schema is None:
            raise LookupError(f"no keyed table at {self.path}")
        else:
            told = {"key": self.key, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "schema": schema.json()}
            out = fs.create(about, False)
            try:
                out.write(bytearray(json.dumps(told).encode()))
            finally:
                out.close()
        self.schema, self.buckets = StructType.fromJson(json.loads(told["schema"])), told["buckets"]
        self.name = f"keyed_{uuid.uuid4().hex[:16]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        by = ", ".join(f"`{k}`" for k in self.key)
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Forget the name; the table stays at its path."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def new_rows(self, rows: DataFrame) -> DataFrame:
        """Of ``rows`` one for each key that the table lacks. Where a delivery
        repeats a key, the least of its rows (column by column) is taken."""
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).dropna(subset=self.key)
        # a map cannot be compared; as text it can
        plain = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in self.schema]
        once = named.groupBy(*[F.col(k).alias(f"__{k}") for k in self.key]).agg(
            F.min_by(F.struct("*"), F.struct(*plain)).alias("row")).select("row.*")
        return once.join(self.read().select(*self.key).hint("merge"), self.key, "left_anti").select(*self.schema.names)

    def insert(self, rows: DataFrame) -> None:
        """Append the rows whose keys are new."""
        self.new_rows(rows).write.format("parquet").mode("append").bucketBy(self.buckets, *self.key) \
            .sortBy(*self.key).option("path", self.path).saveAsTable(self.name)
