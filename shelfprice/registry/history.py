"""Observation history, catalogue pages and store status."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import EFFECTIVE, with_ctes
from shelfprice.functions import labels
from shelfprice.operators import catalog, history, ops

_BRIEF = ["observation_id", "product_id", "store_id", "price", "scraped_at"]


def latest_per_product_store(spark, d):
    return history.latest_per_product_store(t.observations(spark, d)).select(*_BRIEF, "is_available")


def latest_available(spark, d):
    return history.latest_per_product_store(t.observations(spark, d), available_only=True).select(*_BRIEF)


def latest_with_url(spark, d):
    rows = history.latest_with_url(t.observations(spark, d), t.products(spark, d))
    return rows.select("observation_id", "product_id", "store_id", "url")


def last_n_per_product(spark, d):
    return history.last_n_per_product(t.observations(spark, d), 5).select(*_BRIEF, "recency")


def price_history(spark, d):
    rows = history.history(
        t.observations(spark, d), start="1998-01-01 00:00:00", end="2000-12-31 00:00:00", limit=90
    )
    named = t.stores(spark, d).select("store_id", F.col("name").alias("store_name"), "slug")
    return rows.join(named, "store_id").select(*_BRIEF, "store_name", "slug", "recency")


def product_summary(spark, d):
    return history.product_summary(t.observations(spark, d))


def price_trend(spark, d):
    return history.price_trend(t.observations(spark, d))


def catalog_page(spark, d):
    page = catalog.catalog_page(
        t.products(spark, d), t.observations(spark, d), t.tracked(spark, d), category="PROMO", q="BOLT", page=2
    )
    return page.select("product_id", "name", "slug", "observations", "trackers")


def catalog_counts(spark, d):
    rows = catalog.catalog_counts(t.products(spark, d), t.observations(spark, d), t.tracked(spark, d))
    return rows.select("product_id", "name", "observations", "trackers")


def page_meta(spark, d):
    return catalog.page_meta(catalog.catalog_filter(t.products(spark, d), category="PROMO", q="BOLT"), 2)


def by_id_or_slug(spark, d):
    """Half of the keys are identifiers, the others slugs."""
    every = t.products(spark, d)
    keys = every.select(
        F.when(F.col("product_id") % 2 == 0, F.col("product_id").cast("string")).otherwise(F.col("slug")).alias("key")
    )
    return catalog.by_id_or_slug(every, keys).select("key", "product_id", "name")


def size_metadata(spark, d):
    """Metadata exists for the products of one category."""
    every = t.products(spark, d)
    metadata = every.filter("category = 'PROMO'").select(
        "slug", F.concat(F.lit("T"), F.col("product_id") % 7).alias("size"), F.lit("11-16 kg").alias("weight_range")
    )
    return catalog.with_size_metadata(every, metadata).select("product_id", "slug", "size", "weight_range")


def store_status(spark, d):
    rows = ops.store_status(t.stores(spark, d), t.runs(spark, d))
    return rows.select(
        "store_id", "name", "type", "type_label", "run_id", "started_at", "finished_at", "status",
        "status_label", "products_scraped", "error_message",
    )


def status_summary(spark, d):
    return ops.status_summary(ops.store_status(t.stores(spark, d), t.runs(spark, d)))


def run_report(spark, d):
    return ops.run_report(t.runs(spark, d).filter(F.col("finished_at").isNotNull()))


def store_listing(spark, d):
    ranked = t.stores(spark, d).filter("is_active").withColumn("type_rank", labels.store_type_rank(F.col("type")))
    return catalog.listing_order_stores(ranked).select("store_id", "name", "type", "type_rank")


QUERIES = {
    f.__name__: f
    for f in [
        latest_per_product_store, latest_available, latest_with_url, last_n_per_product, price_history,
        product_summary, price_trend, catalog_page, catalog_counts, page_meta, by_id_or_slug, size_metadata, store_status,
        status_summary, run_report, store_listing,
    ]
}

_COLS = "observation_id, product_id, store_id, price, scraped_at"
_FOUND = "is_active AND category = 'PROMO' AND name ILIKE '%BOLT%'"
_STATUS = """SELECT s.*, r.run_id, r.started_at, r.finished_at, coalesce(r.status, 'NEVER') AS status,
    r.products_scraped, r.error_message
  FROM stores s LEFT JOIN (SELECT * FROM runs QUALIFY row_number() OVER
    (PARTITION BY store_id ORDER BY started_at DESC, run_id DESC) = 1) r USING (store_id) WHERE s.is_active"""

SQL = {
    "latest_per_product_store": with_ctes(f"""
      SELECT {_COLS}, is_available FROM observations QUALIFY row_number() OVER
        (PARTITION BY product_id, store_id ORDER BY scraped_at DESC, observation_id DESC) = 1""", "observations"),
    "latest_available": with_ctes(f"SELECT {_COLS} FROM latest", "latest"),
    "latest_with_url": with_ctes("""
      SELECT observation_id, product_id, store_id, url FROM (SELECT * FROM observations WHERE url IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY product_id, store_id
          ORDER BY scraped_at DESC, observation_id DESC) = 1)
      WHERE product_id IN (SELECT product_id FROM products WHERE is_active)""", "observations", "products"),
    "last_n_per_product": with_ctes(f"""
      SELECT {_COLS}, row_number() OVER w AS recency FROM observations
      WINDOW w AS (PARTITION BY product_id ORDER BY scraped_at DESC, observation_id DESC) QUALIFY recency <= 5""",
        "observations"),
    "price_history": with_ctes("""
      SELECT observation_id, product_id, store_id, price, scraped_at, s.name AS store_name, slug, recency
      FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, observation_id DESC)
          AS recency FROM observations
        WHERE scraped_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '2000-12-31') o
      JOIN stores s USING (store_id) WHERE recency <= 90""", "observations", "stores"),
    "product_summary": with_ctes("""
      SELECT product_id, count(*) AS stores, min(price) AS lowest_price,
        min(CAST(price AS DOUBLE) / CAST(package_size AS DOUBLE)) AS lowest_unit_price
      FROM latest GROUP BY product_id""", "latest"),
    "price_trend": with_ctes("""
      SELECT product_id, store_id, day, price, lag(price) OVER w AS previous_price,
        price - lag(price) OVER w AS change
      FROM (SELECT product_id, store_id, CAST(scraped_at AS DATE) AS day, min(price) AS price
        FROM observations GROUP BY ALL)
      WINDOW w AS (PARTITION BY product_id, store_id ORDER BY day)""", "observations"),
    "catalog_page": with_ctes(f"""
      SELECT product_id, name, slug,
        (SELECT count(*) FROM observations o WHERE o.product_id = p.product_id) AS observations,
        (SELECT count(*) FROM tracked x WHERE x.product_id = p.product_id) AS trackers
      FROM (SELECT * FROM products WHERE {_FOUND} ORDER BY name, product_id LIMIT 20 OFFSET 20) p""",
        "products", "observations", "tracked"),
    "catalog_counts": with_ctes("""
      SELECT product_id, name, coalesce(o.n, 0) AS observations, coalesce(x.n, 0) AS trackers FROM products
      LEFT JOIN (SELECT product_id, count(*) AS n FROM observations GROUP BY 1) o USING (product_id)
      LEFT JOIN (SELECT product_id, count(*) AS n FROM tracked GROUP BY 1) x USING (product_id)""",
        "products", "observations", "tracked"),
    "page_meta": with_ctes(f"""
      SELECT 2 AS page, 20 AS page_size, n AS total, CAST(ceil(n / 20.0) AS BIGINT) AS total_pages,
        2 < ceil(n / 20.0) AS has_next, true AS has_prev
      FROM (SELECT count(*) AS n FROM products WHERE {_FOUND})""", "products"),
    "by_id_or_slug": with_ctes("""
      SELECT CASE WHEN product_id % 2 = 0 THEN CAST(product_id AS VARCHAR) ELSE slug END AS key, product_id, name
      FROM products""", "products"),
    "size_metadata": with_ctes("""
      SELECT product_id, slug, CASE WHEN category = 'PROMO' THEN 'T' || product_id % 7 END AS size,
        CASE WHEN category = 'PROMO' THEN '11-16 kg' END AS weight_range FROM products""", "products"),
    "store_status": with_ctes(f"""
      SELECT store_id, name, type, CASE type WHEN 'PHYSICAL' THEN 'Supermercado / Tienda física'
          WHEN 'ONLINE' THEN 'Tienda online' ELSE 'Híbrido' END AS type_label,
        run_id, started_at, finished_at, status,
        CASE status WHEN 'SUCCESS' THEN 'OK' WHEN 'FAILED' THEN 'Error' WHEN 'RUNNING' THEN 'Activo'
          ELSE 'Sin datos' END AS status_label, products_scraped, error_message
      FROM ({_STATUS})""", "stores", "runs"),
    "status_summary": with_ctes(f"""
      SELECT count(*) FILTER (status = 'SUCCESS') AS success, count(*) FILTER (status = 'FAILED') AS failed,
        count(*) FILTER (status = 'NEVER') AS never FROM ({_STATUS})""", "stores", "runs"),
    "run_report": with_ctes("""
      SELECT CAST(sum(products_scraped) AS BIGINT) AS scraped, count(*) FILTER (status = 'FAILED') AS failed,
        count(*) AS stores FROM runs WHERE finished_at IS NOT NULL""", "runs"),
    "store_listing": with_ctes("""
      SELECT store_id, name, type, CASE type WHEN 'ONLINE' THEN 0 WHEN 'PHYSICAL' THEN 1 ELSE 2 END AS type_rank
      FROM stores WHERE is_active""", "stores"),
}
