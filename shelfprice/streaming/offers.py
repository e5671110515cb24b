"""Progressive search: the best offer per store and the ranking move as offers arrive."""

from __future__ import annotations

from copy import deepcopy

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.functions import pricing
from shelfprice.operators import offers as ops
from shelfprice.operators.groups import first_per_group
from shelfprice.operators.validate import validate_offers
from shelfprice.plans.search import askable
from shelfprice.sources.extract import tagged_offers
from shelfprice.sources.tables import spread
from shelfprice.streaming.best_offers import best_offers
from shelfprice.streaming.runs import (
    keyed_state, latest_groups, latest_rows, read_batches, read_log, run_available, work_dir, write_batch,
)

LATE_ROWS = "batch_id long, late long"


def best_offer_updates(stream: DataFrame, queries: DataFrame, least: int = 3, keep_ms: int | None = None) -> DataFrame:
    """Streaming best offers of the stores of each query that changed, for queries of at least `least` characters.

    Offers are validated and matched one by one; the variant filter is judged within the store, as the
    stores answer independently: an offer in conflict only counts while its store has no other. What is known of a query is
    state of its own, so a micro-batch reads and writes the queries it touches and no others. keep_ms forgets
    stores that had no better offer for so long.
    """
    valid, _ = validate_offers(stream)
    return best_offers(ops.keep_relevant(ops.attach_query(valid, askable(queries, least))), keep_ms)


def stream_best_offers(
    spark: SparkSession, stream: DataFrame, queries: DataFrame, path: str | None = None, keep_ms: int | None = None
) -> DataFrame:
    """Run the updates over what has arrived and give the current best offers. Each micro-batch writes the rows that changed."""
    path = path or work_dir(spark, "best-offers")
    updates = best_offer_updates(stream, queries, keep_ms=keep_ms).filter("changed").drop("changed", "conflict", "unit")
    schema = deepcopy(updates.schema)
    with keyed_state(spark):
        writer = updates.writeStream.outputMode("update").foreachBatch(
            lambda batch, batch_id: write_batch(batch, batch_id, f"{path}/log")
        )
        run_available(writer, f"{path}/checkpoint")
    return latest_rows(read_log(spark, f"{path}/log", schema), ["query_id", "store_slug"])


def stream_ranking(
    spark: SparkSession, stream: DataFrame, queries: DataFrame, sort: str = "unit", path: str | None = None, keep_ms: int | None = None
) -> DataFrame:
    """Run the updates and re-rank, after each micro-batch, the queries it changed.

    The state gives all that is known of these queries, so mode and order are worked out again over their whole rows; nothing
    else is read or written.
    """
    path = path or work_dir(spark, "ranking")
    updates = best_offer_updates(stream, queries, keep_ms=keep_ms).drop("conflict", "unit")

    def ranked(rows: DataFrame) -> DataFrame:
        priced = rows.drop("changed").withColumn("shipping_cost", F.lit(None).cast("double"))
        return ops.rank_offers(priced, sort=sort, ties=("store_slug",))

    schema = ranked(spark.createDataFrame([], deepcopy(updates.schema))).schema
    with keyed_state(spark):
        writer = updates.writeStream.outputMode("update").foreachBatch(
            lambda batch, batch_id: write_batch(ranked(batch), batch_id, f"{path}/ranking")
        )
        run_available(writer, f"{path}/checkpoint")
    return latest_groups(read_log(spark, f"{path}/ranking", schema), ["query_id"])


def stream_dedup(
    spark: SparkSession, stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour", path: str | None = None
) -> DataFrame:
    """First arrival of each item; how long a key is remembered is bounded by the watermark.

    Rows later than the delay are dropped; their number per micro-batch is in the table late_rows(path) reads.
    """
    path = path or work_dir(spark, "dedup")
    once = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    late = run_available(
        once.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows"), f"{path}/checkpoint"
    )
    if late:
        spark.createDataFrame(late, LATE_ROWS).write.mode("append").parquet(f"{path}/late")
    return spark.read.schema(once.schema).parquet(f"{path}/rows")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows that the de-duplication under a path dropped for being late: batch_id and number, one row per such batch."""
    try:
        return spark.read.schema(LATE_ROWS).parquet(f"{path}/late")
    except AnalysisException:
        return spark.createDataFrame([], LATE_ROWS)


def stream_enriched(spark: SparkSession, stream: DataFrame, stores: DataFrame, path: str | None = None) -> DataFrame:
    """Offers of active stores with their store columns; the store list is read anew each micro-batch."""
    path = path or work_dir(spark, "enriched")
    known = stores.filter("is_active").select(
        "store_id", F.col("slug").alias("store_slug"), F.col("name").alias("known_name"), "free_shipping_threshold"
    )
    joined = stream.join(known, "store_slug")
    run_available(
        joined.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows"), f"{path}/checkpoint"
    )
    return spark.read.schema(joined.schema).parquet(f"{path}/rows")


def stream_captures(
    spark: SparkSession, captures: DataFrame, path: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Extract offers from arriving captures; unreadable payloads go to a table of their own.

    Gives the offers, those of replayed captures included, and the captures that are still unread (dead_letters).
    """
    path = path or work_dir(spark, "captures")

    def extract(batch: DataFrame, batch_id: int) -> None:
        # One tagged output, so that each payload is read once, not for offers and for rejects.
        write_batch(tagged_offers(spread(batch)).withColumn("attempt", F.lit(1)), batch_id, f"{path}/rows")

    run_available(captures.writeStream.foreachBatch(extract), f"{path}/checkpoint")
    return captured_offers(spark, path), dead_letters(spark, path).select("capture_id", "query_id", "store_slug")


def _attempts(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Everything written under a path: the micro-batches and the replays, or only the replays of smaller numbers."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").drop("batch_id")
    try:
        again = spark.read.option("basePath", f"{path}/replays").parquet(f"{path}/replays")
    except AnalysisException:
        return rows
    if before is not None:
        again = again.filter(F.col("batch_id") < before)
    return rows.unionByName(again.drop("batch_id"))


def captured_offers(spark: SparkSession, path: str) -> DataFrame:
    return _attempts(spark, path).filter("reason IS NULL AND seq IS NOT NULL").drop("reason", "attempt")


def _unread(attempts: DataFrame) -> DataFrame:
    """The last attempt at each capture that none could read."""
    read = attempts.filter("reason IS NULL").select("capture_id").distinct()
    last = first_per_group(attempts.filter("reason IS NOT NULL"), ["capture_id"], [F.col("attempt").desc()])
    return last.join(read, "capture_id", "left_anti").select("capture_id", "query_id", "store_slug", "reason", "attempt")


def dead_letters(spark: SparkSession, path: str) -> DataFrame:
    """(capture_id, query_id, store_slug, reason, attempt) of the captures that no attempt could read: the last attempt of each."""
    return _unread(_attempts(spark, path))


def replay_captures(spark: SparkSession, path: str, repaired: DataFrame, replay_id: int) -> tuple[DataFrame, DataFrame]:
    """Feed repaired captures back: those among the dead letters are read again, all others are left alone.

    So captures whose offers are there are not doubled, whoever sends them again. Of several repairs of a capture the
    newest (fetched_at, then body) counts. What is still unreadable stays a dead letter with one more attempt. replay_id
    numbers the replays; the same one again replaces itself. Gives the offers and dead letters as stream_captures does.
    """
    # A repeated replay must not see its own first attempt.
    known = _unread(_attempts(spark, path, replay_id)).select("capture_id", (F.col("attempt") + 1).alias("attempt"))
    once = first_per_group(repaired, ["capture_id"], [F.col("fetched_at").desc_nulls_last(), F.col("body").desc_nulls_last()])
    again = once.join(known, "capture_id", "left_semi")
    write_batch(tagged_offers(again).join(known, "capture_id"), replay_id, f"{path}/replay-rows")
    rows = spark.read.parquet(f"{path}/replay-rows/batch_id={replay_id}")
    # A capture that can be read but holds no offer is settled too, by a row without an offer.
    empty = again.select("capture_id", "query_id", "store_slug").join(known, "capture_id").join(rows.select("capture_id"), "capture_id", "left_anti")
    write_batch(rows.unionByName(empty, allowMissingColumns=True), replay_id, f"{path}/replays")
    return captured_offers(spark, path), dead_letters(spark, path).select("capture_id", "query_id", "store_slug")


def stream_alerts(
    spark: SparkSession, offers: DataFrame, alerts: DataFrame, path: str | None = None
) -> DataFrame:
    """Alerts fired by arriving offers (query_id is the product): each alert with its first arrival.

    The waiting alerts are worked out and dealt to tasks by product once, on the executors' disks; each micro-batch brings its offers there.
    """
    path = path or work_dir(spark, "alerts")
    waiting = alerts.filter(F.col("is_active") & F.col("triggered_at").isNull()).select(
        "alert_id", F.col("product_id").alias("query_id"), "target_price"
    ).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query_id").persist(StorageLevel.DISK_ONLY)
    price = pricing.effective_price()
    fired = offers.join(waiting, "query_id").filter(price <= F.col("target_price").cast("double")).select(
        "alert_id", F.struct("seq", price.alias("price")).alias("_hit")
    ).groupBy("alert_id").agg(F.min("_hit").alias("_hit"))
    updates = fired.select("alert_id", F.col("_hit.seq").alias("seq"), F.col("_hit.price").alias("price"))
    writer = updates.writeStream.outputMode("update").foreachBatch(
        lambda batch, batch_id: write_batch(batch, batch_id, f"{path}/log")
    )
    try:
        run_available(writer, f"{path}/checkpoint")
    finally:
        waiting.unpersist()
    return latest_rows(read_batches(spark, f"{path}/log", deepcopy(updates.schema)), ["alert_id"])
