"""Maintenance rules, history edges and streaming against batch."""

import pytest
from pyspark.sql import functions as F

from shelfprice import registry
from shelfprice.adapter import tables as t
from shelfprice.operators import catalog, dml, history
from shelfprice.operators.offers import best_per_store, filter_variant_conflicts, rank_offers
from shelfprice.plans.search import askable, relevant_offers
from shelfprice.registry import streams as replay
from shelfprice.streaming import offers as streaming


def test_upsert_keeps_existing_and_first(spark):
    table = spark.createDataFrame([(1, "a", "old")], "id int, slug string, name string")
    rows = spark.createDataFrame([(5, "a", "new"), (7, "b", "second"), (6, "b", "first")], table.schema)
    merged = dml.upsert_missing(table, rows, ["slug"], [F.col("id").asc()])
    assert sorted(map(tuple, merged.collect())) == [(1, "a", "old"), (6, "b", "first")]


def test_update_needs_owner(spark):
    table = spark.createDataFrame([(1, 10, 5.0, True), (2, 20, 6.0, True)], "id int, user_id int, target double, is_active boolean")
    changes = spark.createDataFrame([(1, 10, None, False), (2, 99, 1.0, None)], table.schema)
    updated, rejected = dml.partial_update(table, changes, "id", ["target", "is_active"], owner="user_id")
    assert sorted(map(tuple, updated.collect())) == [(1, 10, 5.0, False), (2, 20, 6.0, True)]
    assert [r.id for r in rejected.collect()] == [2]


def test_older_available_row_wins(spark):
    rows = spark.createDataFrame(
        [("1", 1, 1, "2024-01-01", True), ("2", 1, 1, "2024-01-02", False), ("3", 1, 2, "2024-01-01", True),
         ("4", 1, 2, "2024-01-01", True)],
        "observation_id string, product_id long, store_id long, day string, is_available boolean",
    ).withColumn("scraped_at", F.col("day").cast("timestamp_ntz"))
    assert sorted(r.observation_id for r in history.latest_per_product_store(rows, True).collect()) == ["1", "4"]
    assert sorted(r.observation_id for r in history.latest_per_product_store(rows).collect()) == ["2", "4"]


def test_limits(spark, sf_dir):
    with pytest.raises(ValueError):
        history.history(t.observations(spark, sf_dir), limit=366)
    with pytest.raises(ValueError):
        catalog.paginate(spark.range(3), [F.col("id")], page=0)
    meta = catalog.page_meta(spark.range(0), 1, 20).first()
    assert (meta.total, meta.total_pages, meta.has_next, meta.has_prev) == (0, 0, False, False)
    asked = spark.createDataFrame([(1, " a "), (2, " té ")], "query_id int, query string")
    assert [r["query"] for r in askable(asked).collect()] == ["té"]


def test_every_query_has_its_sql(spark):
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    # Six files, so several micro-batches, the rows of a store spread over all of them.
    events.repartition(6).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(replay._EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    queries = replay._queries(spark, sf_dir)
    batch = filter_variant_conflicts(
        relevant_offers(queries, replay.as_offers(events)), ["query_id", "store_slug"]
    )
    best = best_per_store(batch)
    got = streaming.stream_best_offers(spark, replay.as_offers(source), queries, f"{tmp_path}/best")
    keys = ["query_id", "store_slug", "seq"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, best.select(keys).collect()))

    ranked = rank_offers(best.withColumn("shipping_cost", F.lit(None).cast("double")), ties=("store_slug",))
    live = streaming.stream_ranking(spark, replay.as_offers(source), queries, "unit", f"{tmp_path}/rank")
    cols = ["query_id", "store_slug", "position", "mode", "unit_price"]
    assert sorted(map(tuple, live.select(cols).collect())) == sorted(map(tuple, ranked.select(cols).collect()))


def test_dedup_goes_on_from_its_checkpoint(spark, tmp_path):
    def arrive(n, *rows):
        spark.createDataFrame(rows, "item string, at string").select(
            "item", F.col("at").cast("timestamp").alias("at")
        ).coalesce(1).write.parquet(f"{tmp_path}/in/part={n}")

    def run():
        stream = spark.readStream.schema("item string, at timestamp").parquet(f"{tmp_path}/in/*")
        return streaming.stream_dedup(spark, stream, ["item"], "at", "1 hour", f"{tmp_path}/out")

    arrive(1, ("a", "2024-01-01 10:00:00"), ("b", "2024-01-01 10:01:00"), ("a", "2024-01-01 10:02:00"))
    assert sorted(r.item for r in run().collect()) == ["a", "b"]
    arrive(2, ("a", "2024-01-01 10:30:00"), ("c", "2024-01-01 10:31:00"))
    assert sorted(r.item for r in run().collect()) == ["a", "b", "c"]
