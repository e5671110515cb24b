"""Dear steps run in tasks of a bounded number of rows, and kept views hold no row twice."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfprice.adapter import captures as cap
from shelfprice.adapter import tables as given
from shelfprice.functions import text as forms
from shelfprice.operators import maintained, validate
from shelfprice.plans import matching
from shelfprice.registry import contracts, extraction, text
from shelfprice.schemas import CAPTURES, TABLES
from shelfprice.sources import html_offers as html
from shelfprice.sources import tables
from shelfprice.streaming import offers as streams
from shelfprice.streaming.runs import work_dir

ROWS = 2 * tables.ROWS_PER_TASK + 1


@pytest.fixture(scope="module")
def one_file(tmp_path_factory):
    """A part table of one small file, which a scan gives to one task."""
    path = tmp_path_factory.mktemp("parts")
    duckdb.sql(f"""COPY (SELECT i AS p_partkey, 'leche ' || i AS p_name, 'Brand#1' AS p_brand, 'PROMO' AS p_type, CAST(i % 50 + 1 AS INTEGER) AS p_size,
      1.5::DOUBLE AS p_retailprice FROM range({ROWS}) g(i)) TO '{path}/part.parquet' (FORMAT parquet)""")
    return str(path)


def tasks(rows):
    return rows.rdd.getNumPartitions()


@pytest.mark.parametrize("make", [
    lambda s, d: cap.json_captures(s, d, cap.JSON_SHOPS), lambda s, d: cap.json_captures(s, d, cap.EMBEDDED_SHOPS),
    lambda s, d: cap.html_captures(s, d, cap.HTML_SHOPS), cap.listing_captures, cap.detail_captures, contracts.html_implied_tags,
])
def test_small_files_of_many_rows_are_dealt_out(spark, one_file, make):
    assert tasks(make(spark, one_file)) == 3


def test_spread_keeps_every_row(spark, one_file):
    rows = spark.read.parquet(f"{one_file}/part.parquet")
    rows = rows.unionByName(rows.limit(3)).unionByName(rows.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]))
    dealt = tables.spread(rows, 1000)
    assert tasks(dealt) == (ROWS + 4) // 1000 + 1
    assert dealt.exceptAll(rows).isEmpty() and rows.exceptAll(dealt).isEmpty()
    assert tables.spread(rows.limit(0)).isEmpty()


def test_price_texts_are_dealt_out(spark, tmp_path):
    duckdb.sql(f"""COPY (SELECT i AS l_orderkey, 1 AS l_linenumber, i AS l_partkey, i AS l_suppkey, 2.0::DOUBLE AS l_quantity, 9.0::DOUBLE AS l_extendedprice
      FROM range(100001) g(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    assert tasks(text.price_text_parse(spark, str(tmp_path))) == 2


def test_pages_are_not_broadcast_by_a_guess(spark, one_file, capsys):
    rows = extraction.listing_detail_join(spark, one_file)
    rows.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pages_are_read_once_for_both_rules(spark, one_file, capsys):
    rows = contracts.uncapped_offers(spark, one_file)
    rows.explain()
    assert "MapIn" not in capsys.readouterr().out
    assert {(r.rule, r.n): r["count"] for r in rows.groupBy("rule", "n").count().collect()} == {("capped", 5): ROWS, ("all", 16): ROWS}


def test_a_batch_of_captures_is_dealt_out(spark):
    path, source = work_dir(spark, "captures"), work_dir(spark, "arrivals")
    rows = spark.range(ROWS).select(F.col("id").alias("capture_id"), F.lit("bm").alias("store_slug"), F.lit("<busy>").alias("body"))
    rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CAPTURES])
    rows.coalesce(1).write.parquet(source)
    _, dead = streams.stream_captures(spark, spark.readStream.schema(CAPTURES).parquet(source), path)
    files = spark.read.parquet(f"{path}/rows").select(F.input_file_name().alias("file")).distinct()
    assert files.count() == 3 and dead.count() == ROWS


def test_states_hold_no_row_twice_and_parts_are_settled_together(spark):
    def seen(*rows):
        return spark.createDataFrame(rows, "observation_id string, product_id long, store_id long, scraped_at timestamp_ntz, is_available boolean")

    one, two = "2024-01-01", "2024-01-02"
    rows = [("a", 1, 1, one, True), ("b", 1, 1, two, None), ("c", 1, 2, two, True), ("d", 1, 2, None, False), ("e", None, 2, one, True), ("f", 2, 2, one, False)]
    data = seen().union(spark.createDataFrame(rows, "observation_id string, product_id long, store_id long, scraped_at string, is_available boolean").withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz")))
    days = [data.filter(F.col("observation_id") == i) for i in "abcdef"]
    parts = days[0].transform(maintained.pair_state)
    assert sum(v is not None for v in parts.select("newest_available", "newest_other").first()) == 1
    for day in days[1:5]:
        parts = parts.unionByName(maintained.pair_state(day))
    state = maintained.merge_pairs(parts, days[5])
    assert {r.observation_id for r in maintained.latest_of(state).collect()} == {"b", "c", "e", "f"}
    assert {r.observation_id for r in maintained.latest_of(state, True).collect()} == {"a", "c", "e"}
    assert {tuple(r) for r in maintained.counts_of(state).collect()} == {(1, 4), (2, 1), (None, 1)}


def test_a_day_does_not_write_the_days_before_it(spark, sf_dir):
    from shelfprice.registry import maintained as kept

    base = work_dir(spark, "days").rsplit("/", 1)[0]
    before = set(os.listdir(base))
    kept.maintained_recent(spark, sf_dir)
    (fresh,) = set(os.listdir(base)) - before
    days = [spark.read.parquet(f"{base}/{fresh}/day={k}").count() for k in range(kept.DAYS - 1)]
    whole = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert sum(days) <= whole


def test_a_session_without_a_limit_of_its_own_gets_that_of_the_jvm(spark, sf_dir):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        for own, wanted in [("65535", "8000"), ("20000", "20000")]:
            spark.conf.set(name, own)
            given.table(spark, sf_dir, "part")
            assert spark.conf.get(name) == wanted
    finally:
        spark.conf.set(name, before)


def test_valid_rows_are_found_without_a_list_of_broken_rules(spark, capsys):
    rows = spark.createDataFrame([("a", 9.99), ("b", 0.0), (None, None)], "alert_id string, target_price double")
    valid, rejects = validate.validate_alerts(rows, partial=True)
    valid.explain()
    assert "array" not in capsys.readouterr().out
    assert [r.alert_id for r in valid.collect()] == ["a", None]
    assert [(r.alert_id, r.broken_rules) for r in rejects.collect()] == [("b", ["target_price"])]


def test_titles_fold_alike_with_and_without_other_characters(spark):
    texts = ["Agua 1,5 L", "a\tb\x0b\x0cc\r\n", "a\x1cb\x7f", "Caf\u00e9\u00a0con\u2003GAS", "\u00d1and\u00fa cafe\u0301", "", None, "\U0001f95b leche"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").select(
        "i", "x", forms.plain_spaces(F.col("x")).alias("plain"), F.translate("x", forms.SPACES, " " * len(forms.SPACES)).alias("want"),
        forms.fold(F.col("x")).alias("folded"),
    ).orderBy("i").collect()
    assert [r.plain for r in rows] == [r.want for r in rows]
    assert [r.folded for r in rows][3:] == ["cafe\u00a0con\u2003gas", "nandu cafe", "", None, "\U0001f95b leche"]


def _observed(spark, *rows):
    base = {"product_id": 1, "store_id": 1, "price": 2, "scraped_at": "2024-01-01"}
    made = spark.createDataFrame(list(rows), "observation_id string, product_id int, scraped_at string")
    return made.select(*[
        (F.col(f.name) if f.name in made.columns else F.lit(base.get(f.name))).cast(f.dataType).alias(f.name) for f in TABLES["observations"]
    ])


def test_new_observations_are_shuffled_once_to_be_told_from_stored_ones(spark, capsys):
    path = work_dir(spark, "tables")
    held = [("a", 1, "2024-01-01"), ("a", 1, "2024-01-02"), ("b", 1, None), (None, 2, "2024-01-01"), (None, 3, None), (None, 3, None)]
    tables.append_observations(_observed(spark, *held), path)
    more = _observed(spark, *held, ("c", 1, "2024-01-01"), ("c", 1, "2024-01-01"), (None, 4, "2024-01-01"), ("a", 1, None))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = tables.missing_observations(more, path)
        fresh.explain()
        # One for the rows, one for the stored keys.
        assert capsys.readouterr().out.count("Exchange hashpartitioning") == 2
        assert {(r.observation_id, r.product_id, str(r.scrape_date)) for r in fresh.collect()} == {
            ("c", 1, "2024-01-01"), (None, 4, "2024-01-01"), ("a", 1, "None"),
        }
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tables.append_observations(more, path)
    assert tables.read_observations(spark, path).count() == 8


def test_days_that_hold_nothing_get_their_rows_by_one_shuffle(spark, monkeypatch, capsys):
    monkeypatch.setattr(tables, "ROWS_PER_PIECE", 2)
    rows = [("a", 1, "2024-01-01"), ("a", 1, "2024-01-01"), ("a", 1, "2024-01-02"), ("b", 1, None), ("b", 2, None), (None, 2, "2024-01-01"), (None, 2, "2024-01-01"), (None, 3, "2024-01-01")]
    rows += [(f"c{i}", i, "2024-01-03") for i in range(20)] * 2
    written = []
    write = tables._write_dealt
    monkeypatch.setattr(tables, "_write_dealt", lambda fresh, *rest: (written.append(fresh), write(fresh, *rest)))
    path = work_dir(spark, "tables")
    tables.append_observations(_observed(spark, *rows), path)
    written[0].explain()
    assert capsys.readouterr().out.count("Exchange ") == 1
    held = sorted((r.observation_id or "", r.product_id, str(r.scrape_date)) for r in tables.read_observations(spark, path).collect())
    once = [("", 2, "2024-01-01"), ("", 3, "2024-01-01"), ("a", 1, "2024-01-01"), ("a", 1, "2024-01-02"), *[(f"c{i}", i, "2024-01-03") for i in range(20)]]
    # Of two rows without a day and with one identifier, one stays.
    assert [r for r in held if r[2] != "None"] == sorted(once) and [r[0] for r in held if r[2] == "None"] == ["b"]
    for _ in range(2):
        tables.append_observations(_observed(spark, *rows, ("d", 1, "2024-01-04")), path)
        assert tables.read_observations(spark, path).count() == len(held) + 1
    # More days than are named one by one.
    monkeypatch.setattr(tables, "MOST_DAYS", 1)
    other = work_dir(spark, "tables")
    tables.append_observations(_observed(spark, *rows), other)
    assert tables.read_observations(spark, other).count() == len(held)


def test_rows_of_equal_texts_meet_in_the_last_step(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 2)
    queries = spark.createDataFrame(
        [(i, "Leche") for i in (1, 2, 2, 3, None)] + [(7, "leche"), (8, "agua"), (9, None), (10, ""), (11, "zz")], "query_id long, query string"
    )
    names = spark.createDataFrame(
        [(i, "Leche entera 1 L") for i in (1, 2, 3, 3, 4, None, None)] + [(5, "Agua"), (6, None), (7, ""), (8, "pan")], "name_id long, name string"
    )
    got = matching.match_names(queries, names)
    texts = matching.match_texts(queries, names)
    asked_by = queries.withColumn("asked", forms.search_text(F.col("query")))
    want = texts.join(names, "name").join(asked_by, "asked").select("query_id", "query", "name_id", "name")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.filter("query = 'Leche' AND name = 'Leche entera 1 L'").count() == 35 and got.columns == want.columns
    plan = matching.match_names(queries, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(_") == 2 and plan.rindex("Generate explode(_") < plan.index("Exchange")


def test_terms_are_told_once_per_query_text(spark):
    queries = spark.createDataFrame([(1, "leche entera")], "query_id long, query string")
    asked = matching.asked_queries(queries).select(F.explode("pieces").alias("piece"))
    plan = asked._jdf.queryExecution().optimizedPlan().toString()
    # Nothing but the plain query stands below the first distinct step.
    below = plan[plan.rindex("Aggregate [query"):].splitlines()[1:]
    assert not any("regexp" in line or "translate" in line or "Filter" in line for line in below), plan


def test_alerts_are_worked_out_once_for_all_micro_batches(spark):
    source = work_dir(spark, "arrivals")
    offers = "query_id long, seq long, price double, subscribe_price double"
    for seq in (1, 2, 3):
        spark.createDataFrame([(1, seq, 4.0 - seq, None)], offers).coalesce(1).write.mode("append").parquet(source)
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = [("x", 1, 2.0, True), ("y", 1, 9.0, True), ("z", 1, 9.0, False), ("w", 2, 9.0, True)]
    alerts = spark.createDataFrame(rows, "alert_id string, product_id long, target_price double, is_active boolean").withColumn(
        "target_price", F.udf(count, "double")("target_price")
    ).withColumn("triggered_at", F.lit(None).cast("timestamp_ntz"))
    stream = spark.readStream.schema(offers).option("maxFilesPerTrigger", 1).parquet(source)
    kept = set(spark.sparkContext._jsc.getPersistentRDDs())
    fired = streams.stream_alerts(spark, stream, alerts)
    assert {(r.alert_id, r.seq, r.price) for r in fired.collect()} == {("x", 2, 2.0), ("y", 1, 3.0)}
    assert seen.value <= len(rows)
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
