"""Bad input, ties, repeated keys and late rows."""

import random
import time
from copy import deepcopy
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfprice.functions.quantity import with_quantity
from shelfprice.operators import catalog, dml
from shelfprice.operators.offers import best_per_store
from shelfprice.plans.jobs import same_id
from shelfprice.sources import dom
from shelfprice.sources.html_offers import detail_pages, extract_detail_price
from shelfprice.streaming import offers as streams
from shelfprice.streaming import runs
from shelfprice.streaming.best_offers import best_offers
from shelfprice.streaming.runs import work_dir


def test_overlong_numbers_end_nothing(spark):
    titles = {
        "Pañales 99999999999 uds": (None, None), "Pack de 99999999999": (None, None), "Atun 99999999999 x 80 g": (None, 80.0),
        "Toallitas 3000000 x 4000 uds": (4000, None), "Papel 99999999999 rollos": (None, None), "Agua 9" + "9" * 400 + " l": (None, None),
    }
    rows = with_quantity(spark.createDataFrame([(x,) for x in titles], "title string"), "title").collect()
    assert {r.title: (r.quantity and r.quantity.package_size, r.quantity and r.quantity.net_weight) for r in rows} == titles


def test_a_broken_page_is_a_reject(spark):
    good = '<span class="price__amount">3,20 €</span>'
    pages = spark.createDataFrame(
        [(1, "carrefour", "u1", "<![foo[x]]>" + good), (2, "carrefour", "u2", good), (3, "carrefour", "u3", "<p>x"), (4, "carrefour", "u4", None)],
        "capture_id long, store_slug string, url string, body string",
    )
    rules = {r.capture_id: r.broken_rule for r in detail_pages(pages).collect()}
    assert rules == {1: "unreadable", 2: None, 3: "price", 4: "price"}
    assert [r.price for r in extract_detail_price(pages).collect()] == [3.2]


def test_price_beyond_the_column(spark):
    rows = spark.createDataFrame([(1, 1, 123456789012.0), (2, 1, 1.5), (3, 1, None)], "product_id long, store_id long, price double")
    assert [r.product_id for r in dml.observation_rows(rows, "2026-01-01 00:00:00").orderBy("product_id").collect()] == [2, 3]
    assert [(r.product_id, r.broken_rules) for r in dml.observation_rejects(rows).collect()] == [(1, ["price_range"])]


def test_repeated_keys_do_not_multiply_rows(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    feed = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (9, "z", 1)], "id long, v string, turn int")
    updated, rejected = dml.partial_update(table, feed, "id", ["v"], order=[F.col("turn")])
    assert sorted(updated.collect()) == [(1, "y"), (2, "b")]
    assert sorted(rejected.collect()) == [(1, "x", 2), (9, "z", 1)]
    assert sorted(dml.upsert_columns(table, feed.drop("turn"), "id", ["v"]).collect()) == [(1, "x"), (2, "b"), (9, "z")]
    merged, conflicts = dml.insert_unique(table, spark.createDataFrame([(3, "c"), (3, "d"), (1, "e")], "id long, v string"), ["id"], [F.col("v")])
    assert sorted(merged.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(conflicts.collect()) == [(1, "e"), (3, "d")]


def test_best_offer_does_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "s", 1, c, p, "n", "u", None, None) for c in (7, 3, 5) for p in (2.0, 1.0)]
    kinds = "query_id long, store_slug string, seq long, capture_id long, price double, product_name string, product_url string, subscribe_price double, package_size int"
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        seen.add(best_per_store(spark.createDataFrame(rows, kinds)).select("capture_id", "price").first())
    assert seen == {(3, 1.0)}


def test_two_slugs_of_one_identifier_are_named(spark):
    known = spark.createDataFrame([(1, "a"), (2, "b")], "product_id long, slug string")
    fresh = spark.createDataFrame([(2, "c"), (3, "d")], "product_id long, slug string")
    assert [tuple(r) for r in same_id(known, fresh).collect()] == [(2, 2, "b", "c")]


@pytest.mark.parametrize(("html", "selector", "texts"), [
    ("<ul><li class=t>a<li class=t>b</ul>", ".t", ["a", "b"]),
    ("<ul><li class=t>a<ul><li>x</ul><li class=t>b</ul>", ".t", ["ax", "b"]),
    ("<div><p class=t>a<p class=t>b<div>c</div></div>", ".t", ["a", "b"]),
    ("<table><tr><td class=t>a<td class=t>b<tr><td class=t>c</table>", ".t", ["a", "b", "c"]),
    ("<select><option>a<option>b</select>", "option", ["a", "b"]),
    ("<li class=t><a>a</a></li><li class=t>b</li>", ".t", ["a", "b"]),
])
def test_implied_end_tags(html, selector, texts):
    assert [e.text() for e in dom.parse(html).select(selector)] == texts


def test_pages_by_key_meet_pages_by_number(spark):
    df = spark.createDataFrame([(f"n{i % 7}", i) for i in range(40)], "name string, product_id long")
    order, after, seen = ["name", "product_id"], None, []
    for page in range(1, 6):
        rows = catalog.page_after(df, order, after, 9).collect()
        assert rows == catalog.paginate(df, [F.col(c) for c in order], page, 9).collect()
        seen += rows
        after = tuple(rows[-1])
    assert len(seen) == 40


def _stream(spark, folder):
    from shelfprice.schemas import OFFER_COLUMNS

    stream = spark.readStream.schema("query_id long, seq long, store_slug string, product_name string, price double").option(
        "maxFilesPerTrigger", 1
    ).parquet(folder)
    # Every other offer has a pack size, so that the column has gaps.
    filled = {
        "store_name": F.col("store_slug"), "subscribe_price": F.lit(None).cast("double"), "currency": F.lit("EUR"), "image_url": F.lit(None).cast("string"),
        "product_url": F.lit("https://x.example/1"), "is_available": F.lit(True), "package_size": F.when(F.col("seq") % 2 == 1, 2).cast("int"),
        "net_weight": F.lit(None).cast("double"), "net_weight_unit": F.lit(None).cast("string"), "ean": F.lit(None).cast("string"),
    }
    return stream.withColumns(filled).select("query_id", "seq", *OFFER_COLUMNS)


@pytest.fixture
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


OFFER_ROWS = "query_id long, seq long, store_slug string, product_name string, price double"


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, OFFER_ROWS).coalesce(1).write.mode("append").parquet(folder)


def _size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*") if p.is_file())


def test_bytes_written_per_batch_stay_flat(spark, one_partition, monkeypatch):
    # Fifty plans of validation and relevance would take most of the time; the state is what counts here.
    monkeypatch.setattr(streams, "best_offer_updates", lambda stream, queries, keep_ms: best_offers(stream.join(queries, "query_id"), keep_ms))
    folder, path = work_dir(spark, "in"), work_dir(spark, "ranking")
    # Fifty micro-batches, each with better offers for two of a growing number of queries.
    for i in range(50):
        _arrive(spark, folder, [(q, 1000 * i + q, f"s{k}", "Articulo", 900.0 - i) for q in (i, i + 1) for k in range(3)])
    queries = spark.createDataFrame([(i, "articulo") for i in range(60)], "query_id long, query string")
    ranking = streams.stream_ranking(spark, _stream(spark, folder), queries, path=path)
    assert ranking.count() == 51 * 3 and ranking.filter("position = 1").count() == 51
    written = [_size(f"{path}/ranking/batch_id={i}") for i in range(50)]
    assert max(written[-10:]) <= 1.2 * max(written[:10])
    # The state commits a change log per micro-batch, not the whole state.
    state = Path(f"{path}/checkpoint/state/0/0")
    changes = [(state / f"{i}.changelog").stat().st_size for i in range(2, 51) if (state / f"{i}.changelog").exists()]
    assert len(changes) > 10 and max(changes[-10:]) <= 1.2 * max(changes[:10])


def test_state_goes_on_in_later_runs_and_only_changes_are_written(spark, one_partition):
    folder, path = work_dir(spark, "in"), work_dir(spark, "best")
    queries = spark.createDataFrame([(i, "articulo") for i in range(3)], "query_id long, query string")

    def run():
        rows = streams.stream_best_offers(spark, _stream(spark, folder), queries, path=path)
        return sorted((r.query_id, r.store_slug, r.seq) for r in rows.collect())

    _arrive(spark, folder, [(0, 1, "a", "Articulo", 5.0), (0, 2, "b", "Articulo", 5.0), (1, 3, "a", "Articulo", 5.0)])
    assert run() == [(0, "a", 1), (0, "b", 2), (1, "a", 3)]
    _arrive(spark, folder, [(0, 4, "a", "Articulo", 6.0), (0, 5, "b", "Articulo", 4.0), (0, 0, "a", "Articulo", 2.5), (9, 1, "a", "Articulo", 1.0)])
    assert run() == [(0, "a", 0), (0, "b", 5), (1, "a", 3)]
    _arrive(spark, folder, [(0, 6, "a", "Articulo", 60.0)])
    assert run() == [(0, "a", 0), (0, "b", 5), (1, "a", 3)]
    batches = [spark.read.parquet(str(p)).count() for p in sorted(Path(f"{path}/log").glob("batch_id=*"))]
    assert batches == [3, 2, 0]


def test_state_keeps_all_columns_of_stores_that_do_not_change(spark, one_partition):
    folder = work_dir(spark, "in")
    _arrive(spark, folder, [(0, 1, "a", "Articulo", 5.0), (0, 3, "b", "Articulo", 6.0), (0, 2, "c", "Articulo", 7.0)])
    _arrive(spark, folder, [(0, 5, "b", "Articulo", 4.0)])
    queries = spark.createDataFrame([(0, "articulo")], "query_id long, query string")
    rows = streams.stream_ranking(spark, _stream(spark, folder), queries, path=work_dir(spark, "ranking")).collect()
    assert sorted((r.store_slug, r.seq, r.package_size, r.unit_price, r.position) for r in rows) == [("a", 1, 2, 2.5, 2), ("b", 5, 2, 2.0, 1), ("c", 2, None, None, 3)]


def test_stores_are_forgotten_after_their_time_to_live(spark, one_partition):
    folder, path = work_dir(spark, "in"), work_dir(spark, "ranking")
    queries = spark.createDataFrame([(0, "articulo")], "query_id long, query string")

    def run():
        rows = streams.stream_ranking(spark, _stream(spark, folder), queries, path=path, keep_ms=2000)
        return sorted((r.store_slug, r.position) for r in rows.collect())

    _arrive(spark, folder, [(0, 1, "a", "Articulo", 5.0)])
    assert run() == [("a", 1)]
    time.sleep(3)
    _arrive(spark, folder, [(0, 2, "b", "Articulo", 6.0)])
    assert run() == [("b", 1)]


def test_compacted_log_reads_alike(spark):
    path = work_dir(spark, "log")
    schema = spark.createDataFrame([], "query_id long, store_slug string, price double").schema

    def batch(n, *rows):
        runs.write_batch(spark.createDataFrame(list(rows), schema), n, path)

    def current():
        return sorted(tuple(r) for r in runs.latest_rows(runs.read_log(spark, path, deepcopy(schema)), ["query_id", "store_slug"]).collect())

    batch(0, (1, "a", 5.0), (1, "b", 5.0))
    batch(1, (1, "a", 4.0))
    before = current()
    assert runs.compact_log(spark, path, deepcopy(schema), ["query_id", "store_slug"]) == 1
    assert current() == before == [(1, "a", 4.0), (1, "b", 5.0)]
    batch(2, (1, "a", 3.0), (2, "a", 1.0))
    assert current() == [(1, "a", 3.0), (1, "b", 5.0), (2, "a", 1.0)]
    assert runs.compact_log(spark, path, deepcopy(schema), ["query_id", "store_slug"]) == 2
    rows = runs.read_log(spark, path, deepcopy(schema))
    assert rows.count() == 3 and current() == [(1, "a", 3.0), (1, "b", 5.0), (2, "a", 1.0)]
    # Groups: a micro-batch replaces all rows of a query.
    assert runs.compact_log(spark, path, deepcopy(schema), ["query_id"], whole_groups=True) == 2


def test_late_rows_are_counted(spark):
    folder, path = work_dir(spark, "in"), work_dir(spark, "dedup")
    for moments in (["2026-01-01 10:00:00"], ["2026-01-02 10:00:00"], ["2026-01-01 09:00:00", "2026-01-02 10:00:01"]):
        rows = [(m, m) for m in moments]
        spark.createDataFrame(rows, "item string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("item string, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    kept = streams.stream_dedup(spark, stream, ["item"], "at", "1 hour", path=path)
    assert kept.count() == 3
    assert sum(r.late for r in streams.late_rows(spark, path).collect()) == 1
