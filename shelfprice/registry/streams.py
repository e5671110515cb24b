"""Streaming jobs replayed from the event files; each gives its final state."""

from pyspark.sql import functions as F

from shelfprice.adapter import captures as cap
from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.operators import dml
from shelfprice.operators.groups import first_per_group
from shelfprice.schemas import CAPTURES
from shelfprice.sources.extract import extract_offers
from shelfprice.sources.tables import read_observations
from shelfprice.streaming import offers as streams
from shelfprice.streaming.runs import work_dir
from shelfprice.streaming.scheduled import run_captures

#: Files, and so micro-batches, that the events of a registered stream arrive in.
FILES = 4
#: Files of captures, each a run of a scheduled job.
ARRIVALS = 2
_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def as_offers(events):
    """Events as offers: the user asks, the event type is the store, the value is the price."""
    n = F.col("event_id")
    title = (
        F.when(n % 11 == 0, "Otra cosa").when(n % 7 == 0, "Artículo con gas").otherwise("Artículo normal")
    )
    return events.select(
        F.col("user_id").alias("query_id"), n.alias("seq"), F.col("ts").cast("timestamp").alias("arrived_at"),
        F.col("event_type").alias("store_slug"), F.initcap("event_type").alias("store_name"), title.alias("product_name"),
        F.when(n % 13 == 0, F.lit(0.0)).otherwise(F.col("value")).alias("price"),
        F.when(n % 4 == 0, F.col("value") / 2).alias("subscribe_price"), F.lit("EUR").alias("currency"),
        F.lit(None).cast("string").alias("image_url"), F.concat(F.lit("https://shop.example/"), n).alias("product_url"),
        F.lit(True).alias("is_available"), F.when(n % 3 == 0, (n % 5 + 1).cast("int")).alias("package_size"),
        F.when(n % 2 == 0, F.lit(250.0)).alias("net_weight"), F.when(n % 2 == 0, "g").alias("net_weight_unit"),
        F.lit(None).cast("string").alias("ean"),
    )


def event_stream(spark, d):
    """The events as files that arrive one after another in order of time, each a micro-batch of its own."""
    arrivals = work_dir(spark, "events")
    events = spark.read.schema(_EVENTS).parquet(f"{d}/events.parquet")
    events.repartitionByRange(FILES, "ts", "event_id").sortWithinPartitions("ts", "event_id").write.parquet(arrivals)
    return as_offers(spark.readStream.schema(_EVENTS).option("maxFilesPerTrigger", 1).parquet(arrivals))


def _queries(spark, d):
    return t.table(spark, d, "events").select(F.col("user_id").alias("query_id")).distinct().withColumn(
        "query", F.lit("articulo")
    )


def stream_best_offer(spark, d):
    rows = streams.stream_best_offers(spark, event_stream(spark, d), _queries(spark, d))
    return rows.select("query_id", "store_slug", "seq", "product_name", "price", "package_size")


def _ranking(sort):
    def run(spark, d):
        rows = streams.stream_ranking(spark, event_stream(spark, d), _queries(spark, d), sort)
        return rows.select("query_id", "store_slug", "position", "mode", "unit_price", "effective_price")

    return run


def stream_dedup(spark, d):
    """First event of every user and type; the events come in time order, so the delay may be long."""
    stream = event_stream(spark, d).withColumn("item", F.concat_ws("/", "query_id", "store_slug", "package_size"))
    rows = streams.stream_dedup(spark, stream, ["item"], "arrived_at", "60 days")
    return rows.groupBy("item").agg(F.count("*").alias("n"))


def _event_stores(spark, d):
    return t.table(spark, d, "events").groupBy(F.col("event_type").alias("slug")).agg(
        F.min("event_id").alias("store_id")
    ).select(
        "store_id", "slug", F.upper("slug").alias("name"), (F.col("slug") != "error").alias("is_active"),
        F.lit(None).cast("decimal(10,2)").alias("free_shipping_threshold"),
    )


def stream_enriched(spark, d):
    rows = streams.stream_enriched(spark, event_stream(spark, d), _event_stores(spark, d))
    return rows.select("query_id", "seq", "store_slug", "known_name", "price")


def stream_alerts(spark, d):
    """Alerts of the tracked products (by user number) fired by the replayed offers."""
    alerts = t.alerts(spark, d).withColumn(
        "target_price", (F.col("target_price") / 100).cast("decimal(10,2)")
    )
    rows = streams.stream_alerts(spark, event_stream(spark, d), alerts)
    return rows.select("alert_id", "seq", "price")


def stream_captures(spark, d):
    """Captured payloads arriving as files, extracted batch by batch; counts per store and outcome."""
    shops = ["bm", "nappy", "gadis", "ahorramas"]
    source = work_dir(spark, "arrivals")
    rows = cap.json_captures(spark, d, ["bm", "nappy", "gadis"]).unionByName(
        cap.html_captures(spark, d, ["ahorramas"])
    )
    spoilt = rows.withColumn("body", F.when(F.col("capture_id") % 5 == 0, F.lit("<busy>")).otherwise(F.col("body")))
    spoilt.select(*[f.name for f in CAPTURES]).repartition(FILES, "capture_id").write.parquet(source)
    stream = spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(source).filter(F.col("store_slug").isin(shops))
    offers, rejects = streams.stream_captures(spark, stream)
    return (
        offers.groupBy("store_slug").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("offer"))
        .unionByName(rejects.groupBy("store_slug").agg(F.count("*").alias("n")).withColumn("outcome", F.lit("reject")))
    )


_SHOPS = ["bm", "nappy", "gadis"]


def _arriving(spark, d):
    """Captured payloads that arrive as files, every fifth of them spoilt, and the same ones as they should be."""
    source = work_dir(spark, "arrivals")
    sound = cap.json_captures(spark, d, _SHOPS).select(*[f.name for f in CAPTURES])
    spoilt = sound.withColumn("body", F.when(F.col("capture_id") % 5 == 0, F.lit("<busy>")).otherwise(F.col("body")))
    spoilt.repartition(ARRIVALS, "capture_id").write.parquet(source)
    return spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(source), sound


def incremental_runs(spark, d):
    """Two calls of a scheduled job over the arriving captures; the second finds nothing new. Runs and what they stored, per store."""
    captures, _ = _arriving(spark, d)
    path = work_dir(spark, "runs")
    stores = spark.createDataFrame(list(enumerate(_SHOPS, 1)), "store_id long, slug string")

    def job(batch, before, moment):
        found, _ = extract_offers(batch)
        cheapest = first_per_group(found, ["query_id", "store_slug"], [F.col("price").asc(), F.col("seq").asc()])
        matches = cheapest.join(stores.withColumnRenamed("slug", "store_slug"), "store_slug").select(
            F.col("query_id").alias("product_id"), "store_id", "price", "currency", F.col("product_url").alias("url"), "is_available",
        )
        return dml.observation_rows(matches, moment), None

    for _ in range(2):
        runs = run_captures(spark, captures, path, job, stores, lambda batch_id: f"2003-01-{batch_id + 1:02d} 06:00:00")
    stored = read_observations(spark, path).groupBy("store_id").agg(F.count("*").alias("stored"), F.countDistinct("product_id").alias("products"))
    ended = runs.groupBy("store_id", "status").agg(F.count("*").alias("runs"), F.sum("products_scraped").alias("scraped"))
    return ended.join(stored, "store_id")


def capture_replay(spark, d):
    """Unread captures fed back, first those of even number with all that were read before, then half of the rest again unrepaired."""
    captures, sound = _arriving(spark, d)
    path = work_dir(spark, "captures")
    streams.stream_captures(spark, captures, path)
    streams.replay_captures(spark, path, sound.filter("capture_id % 2 = 0 OR capture_id % 5 <> 0"), 1)
    offers, _ = streams.replay_captures(spark, path, sound.filter("capture_id % 3 = 0").withColumn("body", F.lit("[")), 2)
    read = offers.groupBy("store_slug").agg(F.count("*").alias("n")).withColumns({"reason": F.lit("none"), "attempt": F.lit(0)})
    dead = streams.dead_letters(spark, path).groupBy("store_slug", "reason", "attempt").agg(F.count("*").alias("n"))
    return read.unionByName(dead)


QUERIES = {
    "incremental_runs": incremental_runs,
    "capture_replay": capture_replay,
    "stream_best_offer": stream_best_offer,
    "stream_rerank": _ranking("unit"),
    "stream_rerank_total": _ranking("total"),
    "stream_dedup": stream_dedup,
    "stream_enriched": stream_enriched,
    "stream_alerts": stream_alerts,
    "stream_captures": stream_captures,
}

_OFFERS = """SELECT user_id AS query_id, event_id AS seq, event_type AS store_slug,
    CASE WHEN event_id % 7 = 0 THEN 'Artículo con gas' ELSE 'Artículo normal' END AS product_name, value AS price,
    CASE WHEN event_id % 4 = 0 THEN value / 2 END AS subscribe_price,
    CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 + 1 AS INTEGER) END AS package_size,
    CASE WHEN event_id % 2 = 0 THEN 250.0::DOUBLE END AS net_weight,
    CASE WHEN event_id % 2 = 0 THEN 'g' END AS net_weight_unit, event_id % 7 = 0 AS conflict
  FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND value > 0"""
_BEST = f"""SELECT *, coalesce(subscribe_price, price) AS effective_price FROM ({_OFFERS})
  QUALIFY row_number() OVER (PARTITION BY query_id, store_slug
    ORDER BY conflict, coalesce(subscribe_price, price) / coalesce(package_size, 1), seq) = 1"""
_MODES = """SELECT *, CASE WHEN greatest(g, u) = 0 THEN 'rawPrice' WHEN g = greatest(g, u) THEN 'per100g' ELSE 'perUnit' END
    AS mode FROM (SELECT *, count(net_weight) OVER q AS g,
      count(CASE WHEN net_weight IS NULL THEN package_size END) OVER q AS u
    FROM best WINDOW q AS (PARTITION BY query_id))"""
_PRICED = """SELECT *, CASE mode WHEN 'per100g' THEN effective_price / (coalesce(package_size, 1) * net_weight) * 1000.0::DOUBLE
    WHEN 'perUnit' THEN effective_price / package_size ELSE effective_price END AS unit_price FROM modes"""


def _rank_sql(order: str) -> str:
    return f"""WITH best AS ({_BEST}), modes AS ({_MODES}), priced AS ({_PRICED})
      SELECT query_id, store_slug, row_number() OVER (PARTITION BY query_id ORDER BY {order}, store_slug) AS position,
        mode, unit_price, effective_price FROM priced"""


_SHOP = "(['bm', 'nappy', 'gadis'])[CAST(p_partkey % 3 AS INTEGER) + 1]"

SQL = {
    "incremental_runs": f"""
      SELECT list_position(['bm', 'nappy', 'gadis'], {_SHOP}) AS store_id, 'SUCCESS' AS status, {ARRIVALS} AS runs, count(*) AS scraped,
        count(*) AS stored, count(DISTINCT p_partkey) AS products
      FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1""",
    "capture_replay": f"""
      SELECT {_SHOP} AS store_slug, 2 * count(*) AS n, 'none' AS reason, 0 AS attempt FROM part
      WHERE p_partkey % 5 <> 0 OR p_partkey % 2 = 0 GROUP BY 1
      UNION ALL SELECT {_SHOP}, count(*), 'unreadable', CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END FROM part
      WHERE p_partkey % 5 = 0 AND p_partkey % 2 = 1 GROUP BY ALL""",
    "stream_best_offer": f"SELECT query_id, store_slug, seq, product_name, price, package_size FROM ({_BEST})",
    "stream_rerank": _rank_sql("unit_price NULLS LAST, CASE WHEN unit_price IS NULL THEN effective_price END NULLS LAST"),
    "stream_rerank_total": _rank_sql("effective_price"),
    "stream_dedup": """
      SELECT DISTINCT concat_ws('/', user_id, event_type, CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 1 END) AS item, 1 AS n
      FROM events""",
    "stream_enriched": """
      SELECT user_id AS query_id, event_id AS seq, event_type AS store_slug, upper(event_type) AS known_name,
        CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE value END AS price
      FROM events WHERE event_type <> 'error'""",
    "stream_alerts": with_ctes("""
      SELECT alert_id, seq, price FROM (
        SELECT alert_id, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN value / 2 WHEN event_id % 13 = 0 THEN 0.0::DOUBLE
            ELSE value END AS price, target_price
        FROM alerts JOIN events ON events.user_id = product_id WHERE is_active)
      WHERE price <= CAST(CAST(target_price / 100 AS DECIMAL(10,2)) AS DOUBLE)
      QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY seq) = 1""", "alerts"),
    "stream_captures": """
      WITH c AS (SELECT p_partkey, (['bm', 'nappy', 'gadis'])[CAST(p_partkey % 3 AS INTEGER) + 1] AS store_slug FROM part
        UNION ALL SELECT p_partkey, 'ahorramas' FROM part)
      SELECT store_slug, count(*) * 2 AS n, 'offer' AS outcome FROM c WHERE p_partkey % 5 <> 0 GROUP BY 1
      UNION ALL SELECT store_slug, count(*), 'reject' FROM c WHERE p_partkey % 5 = 0 AND store_slug <> 'ahorramas' GROUP BY 1""",
}
