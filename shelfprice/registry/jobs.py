"""Ingest jobs and table maintenance; every query gives the resulting table or report."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.operators import dml, validate
from shelfprice.plans import jobs
from shelfprice.registry.validation import track_requests
from shelfprice.sources import buckets
from shelfprice.streaming.runs import work_dir

MOMENT = "2003-01-01 06:00:00"
_NEW = ["product_id", "store_id", "price", "subscribe_price", "url", "is_available", "package_size", "net_weight", "scraped_at"]


def discover(spark, d):
    """New observations of a discovery over all active products."""
    job = jobs.discover(t.products(spark, d), t.offers(spark, d), t.stores(spark, d), t.observations(spark, d), MOMENT)
    return job.new_rows.select(*_NEW, "source")


def discover_cleanup(spark, d):
    """Rows per source after a discovery that first removes scraped rows of active products."""
    job = jobs.discover(
        t.products(spark, d), t.offers(spark, d), t.stores(spark, d), t.observations(spark, d), MOMENT, cleanup=True
    )
    return job.tables["observations"].groupBy("product_id", "source").agg(F.count("*").alias("n"))


def discovery_report(spark, d):
    job = jobs.discover(t.products(spark, d), t.offers(spark, d), t.stores(spark, d), t.observations(spark, d), MOMENT)
    report = job.reports["per_product"]
    return report.select("product_id", "product_slug", "discovered", F.array_join("stores", ",").alias("stores"))


def refresh(spark, d):
    """The products of two categories refreshed by identifier or slug."""
    products = t.products(spark, d)
    keys = products.filter("category IN ('PROMO', 'SMALL')").select(
        F.when(F.col("product_id") % 2 == 0, F.col("product_id").cast("string")).otherwise(F.col("slug")).alias("key")
    )
    job = jobs.refresh(keys, products, t.offers(spark, d), t.stores(spark, d), t.observations(spark, d), MOMENT)
    return job.tables["observations"].groupBy("product_id", "source").agg(F.count("*").alias("n"))


_SEED_MOMENT = "1998-01-01 06:00:00"


def seed_daily(spark, d):
    """Seeding on a past day: pairs observed on that day or later are skipped."""
    job = jobs.seed_daily(
        t.products(spark, d), t.offers(spark, d), t.stores(spark, d), t.observations(spark, d), _SEED_MOMENT
    )
    return job.new_rows.select("product_id", "store_id", "price", "url", "package_size", "net_weight", "scraped_at")


def seed_report(spark, d):
    job = jobs.seed_daily(
        t.products(spark, d), t.offers(spark, d), t.stores(spark, d), t.observations(spark, d), _SEED_MOMENT
    )
    return job.reports["totals"]


def _rescrape(spark, d):
    stores = t.stores(spark, d)
    observations = t.observations(spark, d)
    # A fresh price per URL, half a euro below the lowest price seen there, captured twice: the older capture is a euro
    # off. Pages whose URL ends in 7 were not captured, of those that end in 3 the price can't be read.
    last = F.substring("url", -1, 1)
    pages = observations.filter("url is not null").groupBy("url").agg(
        (F.min("price") - F.lit(0.5).cast("decimal(10,2)")).alias("price")
    ).filter(last != "7")
    details = pages.filter(last != "3").select(
        "url", F.explode(F.array(F.lit(1), F.lit(2))).alias("capture_id"), "price", F.lit("EUR").alias("currency"),
        F.lit(True).alias("is_available"),
    ).withColumn("price", F.when(F.col("capture_id") == 1, F.col("price") - 1).otherwise(F.col("price")))
    rejects = pages.filter(last == "3").select("url", F.lit("price").alias("broken_rule"))
    # Every fifth store broke off.
    failures = stores.filter("store_id % 5 = 0").select("slug", F.concat(F.lit("timeout of "), "slug").alias("error_message"))
    registered = stores.filter("type <> 'PHYSICAL'").select("slug")
    return jobs.rescrape(
        observations, t.products(spark, d), stores, registered, details, MOMENT, "2003-01-01 06:10:00", failures, rejects
    )


def rescrape(spark, d):
    return _rescrape(spark, d).new_rows.select("product_id", "store_id", "price", "url", "package_size", "scraped_at")


def rescrape_runs(spark, d):
    """Run log rows of the job: all stores when it starts, and how each ended."""
    reports = _rescrape(spark, d).reports
    return reports["started"].unionByName(reports["runs"])


def rescrape_report(spark, d):
    return _rescrape(spark, d).reports["totals"]


def rescrape_missing(spark, d):
    """Targets without a fresh price, with the reason."""
    return _rescrape(spark, d).reports["missing"]


def _tracking(spark, d):
    return jobs.track_from_search(
        track_requests(spark, d), t.products(spark, d), t.stores(spark, d), t.observations(spark, d),
        t.tracked(spark, d), MOMENT,
    )


def track_from_search(spark, d):
    """Observations stored for the followed search results."""
    return _tracking(spark, d).new_rows.select("observation_id", "store_id", "price", "package_size", "is_available")


def track_products(spark, d):
    return _tracking(spark, d).tables["products"].select("name", "slug", "ean")


def track_followers(spark, d):
    """Followers per user after the requests."""
    return _tracking(spark, d).tables["tracked"].groupBy("user_id").agg(F.count("*").alias("followed"))


def register_by_url(spark, d):
    """Alerts after every customer registers a page of a store."""
    key = F.col("c_custkey")
    slug = F.concat(F.lit("supplier-"), F.lpad((key % 120).cast("string"), 9, "0"))
    requests = t.table(spark, d, "customer").select(
        key.alias("request_id"), key.alias("user_id"), slug.alias("store_slug"),
        F.when(key % 7 == 0, "no url").otherwise(F.concat(F.lit("https://Shop.example:8443/p/"), key)).alias("url"),
        F.when(key % 3 == 0, F.col("c_acctbal")).alias("target_price"),
    )
    job = jobs.register_by_url(
        requests, t.products(spark, d), t.stores(spark, d), t.tracked(spark, d), t.alerts(spark, d), MOMENT
    )
    named = job.tables["products"].select("product_id", "name")
    return job.tables["alerts"].join(named, "product_id").select("alert_id", "user_id", "name", "target_price")


def cleanup_cascade(spark, d):
    """Rows left per table after removing the inactive products."""
    tables = {
        "products": t.products(spark, d), "observations": t.observations(spark, d),
        "tracked": t.tracked(spark, d), "alerts": t.alerts(spark, d), "stores": t.stores(spark, d),
    }
    left = dml.delete_cascade(tables, tables["products"].filter(~F.col("is_active")))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def _alert_changes(spark, d):
    """A change for every alert: a new target, switched off, both or nothing; some by another user."""
    key = F.col("product_id")
    return t.alerts(spark, d).select(
        "alert_id", F.when(key % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        F.when(key % 4 == 0, F.lit(9.99)).cast("decimal(10,2)").alias("target_price"),
        F.when(key % 6 == 0, F.lit(False)).alias("is_active"),
    )


def partial_update(spark, d):
    table, _ = dml.partial_update(
        t.alerts(spark, d), _alert_changes(spark, d), "alert_id", ["target_price", "is_active"], owner="user_id"
    )
    return table.select("alert_id", "user_id", "target_price", "is_active")


def partial_update_rejects(spark, d):
    _, rejected = dml.partial_update(
        t.alerts(spark, d), _alert_changes(spark, d), "alert_id", ["target_price", "is_active"], owner="user_id"
    )
    return rejected.select("alert_id", "user_id")


def untrack(spark, d):
    tracked = t.tracked(spark, d)
    keys = tracked.filter("created_at < '1999-01-01'").select("user_id", "product_id")
    return dml.delete_by_key(tracked, keys, ["user_id", "product_id"])


def insert_products(spark, d):
    """Validated inserts: new slugs go in, existing ones are conflicts."""
    products = t.products(spark, d)
    rows = products.withColumn("product_id", F.col("product_id") + 10_000_000).withColumn(
        "slug", F.when(F.col("product_id") % 3 == 0, F.concat(F.col("slug"), F.lit("-new"))).otherwise(F.col("slug"))
    ).withColumn("ean", F.when(F.col("product_id") % 6 == 0, F.lit("12")).otherwise(F.col("ean")))
    valid, _ = validate.validate_products(rows)
    table, conflicts = dml.insert_unique(products, valid, ["slug"], [F.col("product_id").asc()])
    fresh = table.filter("product_id >= 10000000").select("product_id", "slug", F.lit("inserted").alias("outcome"))
    return fresh.unionByName(conflicts.select("product_id", "slug", F.lit("conflict").alias("outcome")))


def insert_alerts(spark, d):
    """Validated new alerts appended to the table; counts per user."""
    alerts = t.alerts(spark, d)
    rows = alerts.withColumns({
        "alert_id": F.concat(F.lit("new-"), "alert_id"),
        "target_price": (F.col("target_price") - 1000).cast("decimal(10,2)"),
    })
    valid, _ = validate.validate_alerts(rows)
    table, _ = dml.insert_unique(alerts, valid, ["alert_id"], [F.col("alert_id").asc()])
    return table.groupBy("user_id").agg(F.count("*").alias("alerts"))


def seed_stores(spark, d):
    """Store upsert that only touches name, URL, threshold and note of existing stores."""
    stores = t.stores(spark, d)
    rows = stores.withColumns({
        "store_id": F.col("store_id") + 50,
        "name": F.concat(F.lit("Nueva "), "name"), "type": F.lit("BOTH"),
        "shipping_note": F.lit(None).cast("string"),
    }).withColumn("slug", F.concat(F.lit("supplier-"), F.lpad(F.col("store_id").cast("string"), 9, "0")))
    merged = dml.upsert_columns(
        stores, rows, "slug", ["name", "website_url", "free_shipping_threshold", "shipping_note"]
    )
    return merged.select("store_id", "slug", "name", "type", "shipping_note")


def stored_partial_update(spark, d):
    """The alerts' changes applied to a table stored by key, read back whole."""
    alerts, path = t.alerts(spark, d), work_dir(spark, "alerts")
    buckets.write_buckets(alerts, path, ["alert_id"])

    def change(table, changes):
        return dml.partial_update(table, changes, "alert_id", ["target_price", "is_active"], owner="user_id")

    buckets.change_buckets(spark, path, alerts.schema, ["alert_id"], _alert_changes(spark, d), change)
    return buckets.read_buckets(spark, path, alerts.schema, ["alert_id"]).select("alert_id", "user_id", "target_price", "is_active")


def stored_untrack(spark, d):
    """Followers that leave, and some that come back, in a table stored by user and product."""
    tracked, path, key = t.tracked(spark, d), work_dir(spark, "tracked"), ["user_id", "product_id"]
    buckets.write_buckets(tracked, path, key)
    old = tracked.filter("created_at < '1999-01-01'")
    buckets.change_buckets(spark, path, tracked.schema, key, old.select(*key), lambda table, keys: (dml.delete_by_key(table, keys, key), None))
    back = old.filter("user_id % 2 = 0")
    buckets.change_buckets(
        spark, path, tracked.schema, key, back, lambda table, rows: (dml.upsert_missing(table, rows, key, [F.col("created_at").asc()]), None)
    )
    return buckets.read_buckets(spark, path, tracked.schema, key)


QUERIES = {
    f.__name__: f
    for f in [
        stored_partial_update, stored_untrack, discover, discover_cleanup, discovery_report, refresh, seed_daily, seed_report, rescrape, rescrape_runs,
        rescrape_report, rescrape_missing,
        track_from_search, track_products, track_followers, register_by_url, cleanup_cascade, partial_update,
        partial_update_rejects, untrack, insert_products, insert_alerts, seed_stores,
    ]
}

_FOUND = """SELECT s.*, st.store_id FROM searched s JOIN products p ON s.query_id = p.product_id AND p.is_active
  JOIN stores st ON st.slug = s.store_slug AND st.is_active"""
_JOB = ("searched", "products", "stores", "observations")


def _after(keys: str) -> str:
    return with_ctes(f"""
      SELECT product_id, source, count(*) AS n FROM (
        SELECT product_id, source FROM observations
          WHERE NOT (source = 'SCRAPE' AND product_id IN (SELECT product_id FROM products WHERE {keys}))
        UNION ALL SELECT query_id, 'SCRAPE' FROM ({_FOUND}) WHERE query_id IN
          (SELECT product_id FROM products WHERE {keys})) GROUP BY ALL""", *_JOB)


_SEEDED = f"""SELECT f.*, EXISTS (SELECT 1 FROM observations o WHERE o.product_id = f.query_id
    AND o.store_id = f.store_id AND o.scraped_at >= TIMESTAMP '1998-01-01') AS seen FROM ({_FOUND}) f"""
_TARGETS = """SELECT o.product_id, o.store_id, o.url FROM observations o
    JOIN stores s USING (store_id) JOIN products p USING (product_id)
  WHERE s.is_active AND s.type <> 'PHYSICAL' AND url IS NOT NULL AND p.is_active
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY scraped_at DESC, observation_id DESC) = 1"""
_FRESH = f"""SELECT product_id, store_id, url, d.price FROM ({_TARGETS}) JOIN (
  SELECT url, min(price) - CAST(0.5 AS DECIMAL(10,2)) AS price FROM observations WHERE url IS NOT NULL GROUP BY url) d
  USING (url) WHERE right(url, 1) NOT IN ('3', '7')"""
_RUNS = f"""SELECT store_id, TIMESTAMP '{MOMENT}' AS started_at, CAST(NULL AS TIMESTAMP) AS finished_at, 'RUNNING' AS status,
    0 AS products_scraped, CAST(NULL AS VARCHAR) AS error_message
  FROM stores WHERE is_active AND type <> 'PHYSICAL'
  UNION ALL SELECT store_id, TIMESTAMP '{MOMENT}', TIMESTAMP '2003-01-01 06:10:00',
    CASE WHEN store_id % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END, CAST(coalesce(n, 0) AS INTEGER),
    CASE WHEN store_id % 5 = 0 THEN 'timeout of ' || slug END
  FROM stores LEFT JOIN (SELECT store_id, count(*) AS n FROM ({_FRESH}) GROUP BY 1) USING (store_id)
  WHERE is_active AND type <> 'PHYSICAL'"""
_REQUESTS = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
    l_orderkey % 1000 AS user_id, 'Artículo nº ' || l_partkey AS name, 'articulo-n-' || l_partkey AS slug,
    l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(l_quantity AS INTEGER) AS size
  FROM lineitem WHERE l_linenumber NOT IN (3, 4, 5) AND l_suppkey IN (SELECT store_id FROM stores WHERE is_active)"""
_CHANGES = """SELECT alert_id, CASE WHEN product_id % 5 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
    CASE WHEN product_id % 4 = 0 THEN CAST(9.99 AS DECIMAL(10,2)) END AS target_price,
    CASE WHEN product_id % 6 = 0 THEN false END AS is_active
  FROM alerts"""

SQL = {
    "stored_untrack": with_ctes("SELECT * FROM tracked WHERE created_at >= TIMESTAMP '1999-01-01' OR user_id % 2 = 0", "tracked"),
    "discover": with_ctes(f"""
      SELECT query_id AS product_id, store_id, CAST(price AS DECIMAL(10,2)) AS price,
        CAST(subscribe_price AS DECIMAL(10,2)) AS subscribe_price, product_url AS url, is_available, package_size,
        CAST(net_weight AS DECIMAL(10,2)) AS net_weight, TIMESTAMP '{MOMENT}' AS scraped_at, 'SCRAPE' AS source
      FROM ({_FOUND})""", *_JOB),
    "discover_cleanup": _after("is_active"),
    "discovery_report": with_ctes(f"""
      SELECT product_id, slug AS product_slug, coalesce(n, 0) AS discovered, coalesce(stores, '') AS stores FROM products
      LEFT JOIN (SELECT query_id AS product_id, count(*) AS n, string_agg(store_name, ',' ORDER BY price, seq) AS stores
        FROM ({_FOUND}) GROUP BY 1) USING (product_id) WHERE is_active""", *_JOB),
    "refresh": _after("is_active AND category IN ('PROMO', 'SMALL')"),
    "seed_daily": with_ctes(f"""
      SELECT query_id AS product_id, store_id, CAST(price AS DECIMAL(10,2)) AS price, product_url AS url, package_size,
        CAST(NULL AS DECIMAL(10,2)) AS net_weight, TIMESTAMP '{_SEED_MOMENT}' AS scraped_at
      FROM ({_SEEDED}) WHERE NOT seen""", *_JOB),
    "seed_report": with_ctes(f"""
      SELECT count(*) FILTER (NOT seen) AS created, count(*) FILTER (seen) AS skipped FROM ({_SEEDED})""", *_JOB),
    "rescrape": with_ctes(f"""
      SELECT product_id, store_id, price, url, CAST(NULL AS INTEGER) AS package_size, TIMESTAMP '{MOMENT}' AS scraped_at
      FROM ({_FRESH})""", "observations", "stores", "products"),
    "rescrape_runs": with_ctes(_RUNS, "observations", "stores", "products"),
    "rescrape_report": with_ctes(f"""
      SELECT coalesce(sum(products_scraped), 0) AS scraped, count(*) FILTER (status = 'FAILED') AS failed, count(*) AS stores
      FROM ({_RUNS}) WHERE finished_at IS NOT NULL""", "observations", "stores", "products"),
    "rescrape_missing": with_ctes(f"""
      SELECT product_id, store_id, url, CASE right(url, 1) WHEN '3' THEN 'price' ELSE 'no capture' END AS reason
      FROM ({_TARGETS}) WHERE right(url, 1) IN ('3', '7')""", "observations", "stores", "products"),
    "track_from_search": with_ctes(f"""
      SELECT 'track-' || request_id || '-0' AS observation_id, l_suppkey AS store_id,
        CAST(l_extendedprice AS DECIMAL(10,2)) AS price, size AS package_size, true AS is_available FROM ({_REQUESTS})
      UNION ALL SELECT 'track-' || request_id || '-1', store_id, CAST(l_extendedprice + 1 AS DECIMAL(10,2)), size, true
      FROM ({_REQUESTS}) JOIN stores ON store_id = l_suppkey + 1 AND is_active WHERE l_linenumber <> 6""", "stores"),
    "track_products": with_ctes(f"""
      SELECT name, slug, ean FROM products UNION ALL
      SELECT DISTINCT name, slug, lpad(CAST(l_partkey AS VARCHAR), 13, '0') FROM ({_REQUESTS})""", "products", "stores"),
    "track_followers": with_ctes(f"""
      SELECT user_id, count(*) AS followed FROM (SELECT user_id, CAST(product_id AS VARCHAR) AS p FROM tracked
        UNION ALL SELECT DISTINCT user_id, slug FROM ({_REQUESTS})) GROUP BY 1""", "tracked", "stores"),
    "register_by_url": with_ctes("""
      SELECT alert_id, user_id, p.name, target_price FROM alerts JOIN products p USING (product_id)
      UNION ALL SELECT 'url-' || c_custkey, c_custkey, 'shop.example', CAST(c_acctbal AS DECIMAL(10,2)) FROM customer
      WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 0 AND c_acctbal > 0
        AND 'supplier-' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') IN (SELECT slug FROM stores WHERE is_active)""",
        "alerts", "products", "stores"),
    "cleanup_cascade": with_ctes("""
      SELECT 'products' AS name, count(*) AS n FROM products WHERE is_active
      UNION ALL SELECT 'observations', count(*) FROM observations JOIN products USING (product_id) WHERE products.is_active
      UNION ALL SELECT 'tracked', count(*) FROM tracked JOIN products USING (product_id) WHERE products.is_active
      UNION ALL SELECT 'alerts', count(*) FROM alerts JOIN products USING (product_id) WHERE products.is_active
      UNION ALL SELECT 'stores', count(*) FROM stores""", "products", "observations", "alerts", "stores"),
    "partial_update": with_ctes(f"""
      SELECT a.alert_id, a.user_id, coalesce(c.target_price, a.target_price) AS target_price,
        coalesce(c.is_active, a.is_active) AS is_active
      FROM alerts a LEFT JOIN ({_CHANGES}) c USING (alert_id, user_id)""", "alerts"),
    "partial_update_rejects": with_ctes(
        f"SELECT alert_id, user_id FROM ({_CHANGES}) c WHERE (alert_id, user_id) NOT IN (SELECT alert_id, user_id FROM alerts)",
        "alerts"),
    "untrack": with_ctes("SELECT * FROM tracked WHERE created_at >= TIMESTAMP '1999-01-01'", "tracked"),
    "insert_products": with_ctes("""
      SELECT product_id + 10000000 AS product_id, CASE WHEN (product_id + 10000000) % 3 = 0 THEN slug || '-new' ELSE slug END
        AS slug, CASE WHEN (product_id + 10000000) % 3 = 0 THEN 'inserted' ELSE 'conflict' END AS outcome
      FROM products WHERE (product_id + 10000000) % 6 <> 0""", "products"),
    "insert_alerts": with_ctes("""
      SELECT user_id, count(*) AS alerts FROM (SELECT user_id FROM alerts
        UNION ALL SELECT user_id FROM alerts WHERE target_price > 1000) GROUP BY 1""", "alerts"),
    "seed_stores": with_ctes("""
      SELECT coalesce(s.store_id, n.store_id + 50) AS store_id,
        coalesce(s.slug, 'supplier-' || lpad(CAST(n.store_id + 50 AS VARCHAR), 9, '0')) AS slug,
        CASE WHEN n.store_id IS NULL THEN s.name ELSE 'Nueva ' || n.name END AS name,
        coalesce(s.type, 'BOTH') AS type, CASE WHEN n.store_id IS NULL THEN s.shipping_note END AS shipping_note
      FROM stores s FULL JOIN stores n ON s.store_id = n.store_id + 50""", "stores"),
}
SQL["stored_partial_update"] = SQL["partial_update"]
