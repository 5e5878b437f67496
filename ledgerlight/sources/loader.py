"""Bulk CSV load into parquet tables.

Relational files are appended, and their primary keys hold: a row whose key the
table has already is skipped, so loading a file twice equals loading it once.
Document collections replace their table.
A missing file is reported and skipped; a malformed row is kept in a
quarantine table (``<table>__rejected``) with its raw text instead of
stopping the load. Every file is read with its explicit schema, in
parallel splits, by the executors.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerlight.sources.keyed import KeyedTable
from ledgerlight.sources.schemas import COLLECTIONS, PRIMARY_KEYS, RELATIONAL, schema_of

log = logging.getLogger(__name__)
CORRUPT = "_corrupt_record"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (works for
    local, HDFS and object stores alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One CSV file (or folder of parts) with the table's schema plus a
    corrupt-record column for rows that do not fit it."""
    schema = schema_of(table)
    with_corrupt = StructType(list(schema.fields) + [StructField(CORRUPT, StringType())])
    return (spark.read.option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", False)
            .option("escape", '"').schema(with_corrupt).csv(path))


def load_csv_dir(spark: SparkSession, csv_dir: str, target_dir: str,
                 tables: tuple[str, ...] = RELATIONAL + COLLECTIONS, unique: bool = True) -> dict[str, dict]:
    """Load ``<csv_dir>/<table>.csv`` files into ``<target_dir>/<table>``.

    Returns per table: status ('loaded' / 'missing') and row counts (loaded
    and rejected), counted while the rows are written; for tables with a
    primary key also the rows skipped because of it. ``unique=False`` appends
    whatever the files hold, without looking at keys.
    """
    report: dict[str, dict] = {}
    for table in tables:
        src = f"{csv_dir.rstrip('/')}/{table}.csv"
        if not path_exists(spark, src):
            log.warning("file not found, skipped: %s", src)
            report[table] = {"status": "missing"}
            continue
        df = read_csv(spark, src, table)
        mode = "overwrite" if table in COLLECTIONS else "append"
        dest = f"{target_dir.rstrip('/')}/{table}"
        # counted while the good rows are written: one pass over the file
        seen = Observation(f"load {table}")
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rejected"))
        good = counted.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
        keyed = KeyedTable(spark, dest, PRIMARY_KEYS[table], schema_of(table)) if unique and table in PRIMARY_KEYS else None
        if keyed:
            before = keyed.read().count()
            keyed.insert(good)
            added = keyed.read().count() - before
            keyed.close()
        else:
            good.write.mode(mode).parquet(dest)
        counts = seen.get
        if counts["rejected"]:
            log.warning("%s: %d malformed rows quarantined", table, counts["rejected"])
            # beside the raw text, what was read as the first column
            df.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("raw"), schema_of(table).names[0]) \
                .write.mode(mode).parquet(f"{dest}__rejected")
        fitting = counts["rows"] - counts["rejected"]
        report[table] = {"status": "loaded", "mode": mode, "rows": added if keyed else fitting, "rejected": counts["rejected"]}
        if keyed:
            report[table]["skipped"] = fitting - added
    return report
