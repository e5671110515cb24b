"""Locations and triggers shared by the streaming jobs."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.operators.groups import first_per_group


def work_dir(spark: SparkSession, name: str) -> str:
    """Fresh folder for a run below the cluster's shared checkpoint folder.

    Without that setting a plain local session, which is one process, uses a temporary folder; any other master is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share, or give a path")
        base = tempfile.mkdtemp(prefix="shelfprice-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_available(writer, checkpoint: str) -> list[tuple[int, int]]:
    """Process everything that has arrived, then stop; a later run goes on from the checkpoint.

    Gives (batch_id, rows) for the micro-batches whose state operators dropped rows behind the watermark.
    """
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    late = ((p.batchId, sum(s.numRowsDroppedByWatermark for s in p.stateOperators)) for p in query.recentProgress)
    return [(batch_id, n) for batch_id, n in late if n]


def write_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch into its own folder; a repeated batch replaces its earlier attempt."""
    batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB and commit only what a micro-batch changed.

    What has outlived its time is dropped by micro-batches with data; one without would follow the other for ever.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """All micro-batches written so far, with their batch_id."""
    fields = schema.add("batch_id", "long") if "batch_id" not in schema.fieldNames() else schema
    return spark.read.schema(fields).option("basePath", path).parquet(path)


def read_log(spark: SparkSession, path: str, schema) -> DataFrame:
    """What a log of updates still says: its newest compaction, if there is one, and the micro-batches after it."""
    upto = compacted_upto(spark, path)
    try:
        rows = read_batches(spark, path, schema)
    except AnalysisException:
        # Nothing has arrived yet.
        return spark.createDataFrame([], schema)
    if upto is None:
        return rows
    base = spark.read.schema(rows.schema).parquet(f"{path}-compacted/upto={upto}")
    return base.unionByName(rows.filter(F.col("batch_id") > upto))


def compacted_upto(spark: SparkSession, path: str) -> int | None:
    try:
        return spark.read.option("basePath", f"{path}-compacted").parquet(f"{path}-compacted").agg(F.max("upto")).first()[0]
    except AnalysisException:
        return None


def compact_log(spark: SparkSession, path: str, schema, keys: list[str], whole_groups: bool = False) -> int | None:
    """Write the rows that a log still holds as one table; later reads start from it. Gives the last micro-batch it covers.

    With whole_groups a micro-batch replaces all rows of a key, else the one row of a key. Micro-batches up to the one given are no longer
    read and may be removed, as may older compactions. A run that breaks off leaves the log as it was.
    """
    log = read_log(spark, path, schema)
    upto = log.agg(F.max("batch_id")).first()[0]
    if upto is not None and upto != compacted_upto(spark, path):
        newest = log.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
        rows = log.join(newest, [*keys, "batch_id"]) if whole_groups else first_per_group(log, keys, [F.col("batch_id").desc()])
        rows.write.mode("overwrite").parquet(f"{path}-compacted/upto={upto}")
    return upto


def latest_rows(log: DataFrame, keys: list[str]) -> DataFrame:
    """Current row of every key in a log of updates."""
    return first_per_group(log, keys, [F.col("batch_id").desc()]).drop("batch_id")


def latest_groups(log: DataFrame, group: list[str]) -> DataFrame:
    """Rows of the last batch that rewrote each group."""
    newest = log.groupBy(*group).agg(F.max("batch_id").alias("batch_id"))
    return log.join(newest, [*group, "batch_id"]).drop("batch_id")
