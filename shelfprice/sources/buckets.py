"""Tables that change by key, stored in folders of keys: a change reads and rewrites the folders of its keys only."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfprice.streaming.runs import work_dir

#: Folders of a table. It has to stay the same for the life of a table.
BUCKETS = 64

#: Gives the new state of the rows that changes may touch, and rows to report.
Change = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame | None]]


def bucket_of(key: Sequence[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: Sequence[str]) -> None:
    (
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def write_buckets(rows: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """Store a table by the hash of its key, sorted by key within a folder. Keys must not be null."""
    _write(rows.withColumn("bucket", bucket_of(key, buckets)), path, key)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], changes: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The table, or only the folders that keys of the changes fall into (at most one number per folder reaches the driver)."""
    rows = _stored(spark, path, schema)
    if changes is not None:
        touched = [r.bucket for r in changes.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()]
        rows = rows.filter(F.col("bucket").isin(touched))
    return rows.filter(F.col(key[0]).isNotNull()).drop("bucket")


def change_buckets(
    spark: SparkSession, path: str, schema: T.StructType, key: Sequence[str], changes: DataFrame, change: Change, buckets: int = BUCKETS
) -> DataFrame | None:
    """Apply a change, such as those of operators/dml, to the folders that its keys fall into; all other folders keep their files.

    The key of the table has to be part of the changes. Few changes are sent to the table's rows where they lie, by their measured
    size; the rows are not shuffled to meet them. A folder that loses all its rows keeps one without a key, which
    no reader sees. Gives the change's report. One writer at a time; folders are replaced when all are written, so a run that breaks off before
    that leaves the table as it was, and the same changes may be applied again.
    """
    kept, report = change(read_buckets(spark, path, schema, key, changes, buckets), changes)
    if report is not None:
        # It is made from the files that are about to be replaced.
        held = work_dir(spark, "report")
        report.write.parquet(held)
        report = spark.read.schema(report.schema).parquet(held)
    touched = changes.select(bucket_of(key, buckets).alias("bucket")).distinct()
    empty = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema], "bucket")
    rows = kept.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).withColumn("bucket", bucket_of(key, buckets))
    _write(rows.unionByName(empty), path, key)
    return report
