"""Repeatable writes, scheduled runs that break off, replayed captures, maintained views and stored indexes."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.operators import dml, history, maintained
from shelfprice.plans import index
from shelfprice.plans.matching import match_texts
from shelfprice.schemas import CAPTURES, OBSERVATIONS
from shelfprice.sources import buckets
from shelfprice.sources.tables import append_observations, compact_observations, of_days, read_observations
from shelfprice.streaming import offers as streams
from shelfprice.streaming import scheduled
from shelfprice.streaming.runs import work_dir


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def _observations(spark, rows):
    """Observations from (id, product, moment, price)."""
    made = spark.createDataFrame(rows, "observation_id string, product_id long, at string, price double").withColumns({
        "scraped_at": F.col("at").cast("timestamp_ntz"), "store_id": F.lit(1).cast("long"), "is_available": F.lit(True),
    })
    return made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATIONS])


def _ids(spark, path):
    return sorted((r.observation_id or "", str(r.scrape_date), r.product_id) for r in read_observations(spark, path).collect())


def test_append_is_repeatable(spark):
    path = work_dir(spark, "tables")
    first = _observations(spark, [("a", 1, "2026-01-01 10:00:00", 1.0), ("b", 2, "2026-01-02 10:00:00", 2.0), (None, 3, "2026-01-02 11:00:00", 3.0), ("n", 4, None, 1.0)])
    append_observations(first, path)
    once, files = _ids(spark, path), _files(path)
    assert len(once) == 4
    append_observations(first, path)
    assert _ids(spark, path) == once and _files(path) == files
    # Part of a run had been written before it broke off: the rest is added, other days keep their files.
    append_observations(first.unionByName(_observations(spark, [("c", 5, "2026-01-02 12:00:00", 1.0), ("c", 5, "2026-01-02 12:00:00", 1.0), ("a", 9, "2026-01-03 10:00:00", 1.0)])), path)
    assert len(_ids(spark, path)) == 6
    assert set(files) < set(_files(path))
    # A day in many files becomes one again; the others keep theirs.
    before = _files(path)
    compact_observations(spark, path, ["2026-01-02"])
    after = _files(path)
    assert len(_ids(spark, path)) == 6
    assert len([f for f in after if "2026-01-02" in f]) == 1 and {f for f in before if "2026-01-02" not in f} <= set(after)


def test_appends_read_their_days_only(spark, monkeypatch):
    path = work_dir(spark, "tables")
    append_observations(_observations(spark, [(f"o{i}", i, f"2026-01-{i + 1:02d} 10:00:00", 1.0) for i in range(6)]), path)
    day = spark.createDataFrame([("2026-01-03",)], "day string").select(F.col("day").cast("date").alias("scrape_date"))
    assert len(of_days(read_observations(spark, path), day).inputFiles()) == 6  # pruned when it runs
    assert "PartitionFilters: [((scrape_date" in of_days(read_observations(spark, path), day)._jdf.queryExecution().toString()
    monkeypatch.setattr("shelfprice.sources.tables.MOST_DAYS", 1)
    two = spark.createDataFrame([("2026-01-02",), ("2026-01-04",)], "day string").select(F.col("day").cast("date").alias("scrape_date"))
    assert of_days(read_observations(spark, path), two).count() == 3


def _captures(spark, folder, rows):
    made = spark.createDataFrame(rows, "capture_id long, store_slug string, query_id long, body string")
    made.select(*[(F.col(f.name) if f.name in made.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CAPTURES]).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(folder)


def _price_job(fail_after=()):
    """One observation per capture, its body the price; breaks off after the append of the given moments."""

    def job(batch, before, moment):
        matches = batch.select(F.col("query_id").alias("product_id"), F.when(F.col("store_slug") == "a", 1).otherwise(2).alias("store_id"), F.col("body").cast("double").alias("price"))
        rows = dml.observation_rows(matches, moment)
        if moment in fail_after:
            append_observations(rows.limit(1), job.path)
            raise RuntimeError("executor lost")
        return rows, batch.sparkSession.createDataFrame([("b", "timeout")], "slug string, error_message string")

    return job


def test_a_run_that_breaks_off_is_taken_up_again(spark):
    folder, path = work_dir(spark, "captures"), work_dir(spark, "runs")
    stores = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "store_id long, slug string")
    stream = _captures(spark, folder, [(1, "a", 10, "1.5"), (2, "a", 11, "2.5"), (3, "b", 10, "3.5")])
    moments = iter(range(1, 100))

    def clock(batch_id):
        # Every call gives another moment, as a clock does; a run that is taken up again must keep its own.
        return f"2026-01-01 06:00:{next(moments):02d}"

    broken = _price_job(fail_after=("2026-01-01 06:00:01",))
    broken.path = path
    with pytest.raises(Exception, match="executor lost"):
        scheduled.run_captures(spark, stream, path, broken, stores, clock)
    assert {(r.store_id, r.status) for r in scheduled.read_runs(spark, path).collect()} == {(1, "RUNNING"), (2, "RUNNING")}
    assert read_observations(spark, path).count() == 1

    runs = {(r.batch_id, r.store_id): r for r in scheduled.run_captures(spark, stream, path, _price_job(), stores, clock).collect()}
    assert {k: (r.status, r.products_scraped, r.error_message) for k, r in runs.items()} == {(0, 1): ("SUCCESS", 2, None), (0, 2): ("FAILED", 1, "timeout")}
    assert {str(r.started_at) for r in runs.values()} == {"2026-01-01 06:00:01"}
    assert read_observations(spark, path).count() == 3
    # Nothing new: nothing changes. Another file is a run of its own.
    assert scheduled.run_captures(spark, stream, path, _price_job(), stores, clock).count() == 2
    _captures(spark, folder, [(4, "a", 10, "1.0"), (5, "z", 10, "9.0")])
    assert scheduled.run_captures(spark, stream, path, _price_job(), stores, clock).count() == 3


def test_replay_reads_dead_letters_only(spark):
    folder, path = work_dir(spark, "captures"), work_dir(spark, "offers")
    stream = _captures(spark, folder, [(1, "bm", 10, "<busy>"), (2, "bm", 10, None), (3, "ahorramas", 10, None), (4, "bm", 11, "<busy>")])
    offers, _ = streams.stream_captures(spark, stream, path)

    def dead():
        return sorted((r.capture_id, r.reason, r.attempt) for r in streams.dead_letters(spark, path).collect())

    assert offers.count() == 0
    assert dead() == [(1, "unreadable", 1), (2, "no body", 1), (3, "no body", 1), (4, "unreadable", 1)]
    sound = '{"products": []}'
    repaired = spark.createDataFrame([(1, "bm", 10, sound), (3, "ahorramas", 10, "<html></html>"), (4, "bm", 11, "<still busy>"), (9, "bm", 10, "x")], "capture_id long, store_slug string, query_id long, body string")
    repaired = repaired.select(*[(F.col(f.name) if f.name in repaired.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CAPTURES])
    for _ in range(2):
        # The same replay again replaces itself.
        streams.replay_captures(spark, path, repaired, 1)
        assert dead() == [(2, "no body", 1), (4, "unreadable", 2)]
    streams.replay_captures(spark, path, repaired, 2)
    assert dead() == [(2, "no body", 1), (4, "unreadable", 3)]


def test_maintained_views_equal_views_made_anew(spark, sf_dir):
    rows = t.observations(spark, sf_dir)
    days = [rows.filter(F.pmod(F.dayofyear("scraped_at"), F.lit(3)) == k) for k in range(3)]
    pairs, recent = maintained.pair_state(days[2]), maintained.recent_state(days[2], 5)
    for day in (days[0], days[1]):
        pairs, recent = maintained.merge_pairs(pairs, day), maintained.merge_recent(recent, day, 5)
    pairs, recent = pairs.persist(), recent.persist()
    key = ["observation_id"]
    gone, left = rows.filter("product_id % 3 = 0 AND source = 'SCRAPE'"), rows.filter("NOT (product_id % 3 = 0 AND source = 'SCRAPE')")
    for state, kept, all_rows in (
        (pairs, recent, rows),
        (maintained.retract_pairs(pairs, gone, left), maintained.retract_recent(recent, gone, left, 5), left),
    ):
        for available in (False, True):
            anew = history.latest_per_product_store(all_rows, available)
            assert maintained.differing(maintained.latest_of(state, available), anew, key).isEmpty()
        assert maintained.differing(maintained.counts_of(state), all_rows.groupBy("product_id").agg(F.count("*").alias("observations")), ["product_id", "observations"]).isEmpty()
        assert maintained.differing(kept, history.last_n_per_product(all_rows, 5), [*key, "recency"]).isEmpty()


def test_indexed_names_match_as_all_do(spark):
    names = ["Leche entera 1 L", "Leche desnatada", "Pañales talla 5", "Agua con gas", "Ñora", "a", "", "Chocolate negro 85", "Café molido natural"]
    queries = ["leche", "leche entera", "panales talla 5", "agua", "chocolate negro", "x", "", "cafe molido", "85"]
    all_names, all_queries = spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(q,) for q in queries], "query string")
    path = work_dir(spark, "pieces")
    index.index_names(all_names.limit(4), path)
    rest = all_names.exceptAll(all_names.limit(4))
    full = {tuple(r) for r in match_texts(all_queries, all_names).select("asked", "name").collect()}
    known = match_texts(all_queries.limit(3), all_names.limit(4)).select("asked", "name")
    delta = index.match_delta(spark, all_queries.limit(3), all_queries.exceptAll(all_queries.limit(3)), rest, path)
    assert {tuple(r) for r in known.unionByName(delta.select("asked", "name")).collect()} == full
    for _ in range(2):
        index.add_names(spark, rest, path)
    found = index.match_new_queries(spark, all_queries, path)
    assert {tuple(r) for r in found.select("asked", "name").collect()} == full and found.count() == len(full)


def test_letters_equal_a_scan_and_read_their_folders(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["Aceite de Oliva", "ACEITUNA", "pan", "Pan de molde", "", None, "Ácido", "oliva"])], "id long, name string")
    path = work_dir(spark, "letters")
    index.index_text(rows, "id", "name", path)
    for needle in ("a", "an", "ace", "OLIVA", "pan de", "ácido", "aceite de oliva", "zzz", "aceituna verde", ""):
        scan = rows.filter(F.contains(F.lower("name"), F.lower(F.lit(needle)))).collect()
        assert sorted(r.id for r in index.search_text_index(spark, rows, "id", "name", needle, path).collect()) == sorted(r.id for r in scan), needle
    plan = index.search_text_index(spark, rows, "id", "name", "oliva", path)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan


def test_changes_rewrite_the_folders_of_their_keys_only(spark):
    path, key = work_dir(spark, "alerts"), ["alert_id"]
    table = spark.createDataFrame([(f"a{i}", i % 3, float(i)) for i in range(200)], "alert_id string, user_id long, target double")
    buckets.write_buckets(table, path, key, 16)
    before = _files(path)
    changes = spark.createDataFrame([("a7", 1, 0.5), ("a9", 2, 0.5), ("zz", 1, 0.5)], "alert_id string, user_id long, target double")

    def update(rows, new):
        return dml.partial_update(rows, new, "alert_id", ["target"], owner="user_id")

    rejected = buckets.change_buckets(spark, path, table.schema, key, changes, update, 16)
    assert sorted(r.alert_id for r in rejected.collect()) == ["a9", "zz"]
    touched = {f"bucket={r[0]}" for r in changes.select(buckets.bucket_of(key, 16)).collect()}
    after = _files(path)
    assert {f for f in before if not any(t + "/" in f for t in touched)} == {f for f in after if not any(t + "/" in f for t in touched)}
    held = {r.alert_id: r.target for r in buckets.read_buckets(spark, path, table.schema, key).collect()}
    assert held == {f"a{i}": 0.5 if i == 7 else float(i) for i in range(200)}
    # A folder that loses all of its rows is empty afterwards, and can be filled again.
    gone = table.filter(buckets.bucket_of(key, 16) == 3).select("alert_id")
    assert gone.count() > 0
    buckets.change_buckets(spark, path, table.schema, key, gone, lambda rows, keys: (dml.delete_by_key(rows, keys, key), None), 16)
    assert buckets.read_buckets(spark, path, table.schema, key).count() == 200 - gone.count()
    back = table.join(gone, "alert_id").select(*table.columns)
    buckets.change_buckets(spark, path, table.schema, key, back, lambda rows, new: (dml.upsert_missing(rows, new, key, [F.col("target").asc()]), None), 16)
    assert buckets.read_buckets(spark, path, table.schema, key).count() == 200


def test_table_rows_are_not_shuffled_to_meet_few_changes(spark):
    path, key = work_dir(spark, "tracked"), ["user_id"]
    table = spark.range(5000).select(F.col("id").alias("user_id"), (F.col("id") * 2).alias("product_id"))
    buckets.write_buckets(table, path, key)
    few = work_dir(spark, "few")
    spark.createDataFrame([(3,), (4,)], "user_id long").write.parquet(few)
    keys = spark.read.parquet(few)
    left = dml.delete_by_key(buckets.read_buckets(spark, path, table.schema, key, keys), keys, key)
    assert left.count() > 0
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan and "PartitionFilters: [bucket" in plan
