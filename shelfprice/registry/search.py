"""Relevance, variants, best per store and searches."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.operators import offers, ops
from shelfprice.operators.validate import validate_offers
from shelfprice.plans.search import relevant_offers, search_offers

_KEY = ["query_id", "seq", "store_slug", "product_name", "price"]


def _relevant(spark, d):
    return relevant_offers(t.queries(spark, d), t.offers(spark, d))


def relevant(spark, d):
    return _relevant(spark, d).select(*_KEY, "query")


def variant_filter(spark, d):
    return offers.filter_variant_conflicts(_relevant(spark, d)).select(*_KEY)


def variant_filter_per_store(spark, d):
    """The same filter judged store by store, as in progressive results."""
    return offers.filter_variant_conflicts(_relevant(spark, d), ["query_id", "store_slug"]).select(*_KEY)


def best_per_store_unit(spark, d):
    return offers.best_per_store(_relevant(spark, d)).select(*_KEY)


def best_per_store_price(spark, d):
    return offers.best_per_store(_relevant(spark, d), by="price").select(*_KEY)


def search(spark, d):
    rows = search_offers(t.queries(spark, d), t.offers(spark, d))
    return rows.select(*_KEY, "subscribe_price", "package_size", "product_url", "is_available", "ean", "position")


def coverage_report(spark, d):
    valid, _ = validate_offers(t.offers(spark, d))
    return ops.coverage_report(valid, t.queries(spark, d))


def missing_quantity_names(spark, d):
    valid, _ = validate_offers(t.offers(spark, d))
    return ops.missing_quantity_names(valid).select("store_slug", "query_id", "seq", "product_name")


def _outcomes(spark, d):
    """Probe outcomes: results of each store's run, or an HTTP status when the run failed."""
    code = F.when(F.col("status") == "FAILED", "503").when(F.col("status") == "RUNNING", "timeout").otherwise("200")
    return t.runs(spark, d).select(
        "run_id", F.col("products_scraped").alias("results"), code.alias("http_status")
    )


def scraper_health(spark, d):
    return ops.scraper_health(_outcomes(spark, d))


def health_summary(spark, d):
    return ops.health_summary(_outcomes(spark, d))


QUERIES = {
    "relevant_offers": relevant,
    "variant_filter": variant_filter,
    "variant_filter_per_store": variant_filter_per_store,
    "best_per_store_unit": best_per_store_unit,
    "best_per_store_price": best_per_store_price,
    "search_offers": search,
    "coverage_report": coverage_report,
    "missing_quantity_names": missing_quantity_names,
    "scraper_health": scraper_health,
    "health_summary": health_summary,
}

_COLS = "query_id, seq, store_slug, product_name, price"
_OUTCOMES = """SELECT run_id, products_scraped AS results, CASE status WHEN 'FAILED' THEN '503'
  WHEN 'RUNNING' THEN 'timeout' ELSE '200' END AS http_status FROM runs"""
_HEALTH = "CASE WHEN results > 0 THEN 'passed' WHEN http_status = '200' THEN 'empty' ELSE 'blocked' END"


def _variant_sql(group: str) -> str:
    return with_ctes(f"""SELECT {_COLS} FROM (SELECT *, bool_or(NOT conflict) OVER (PARTITION BY {group})
      AS any_clean FROM relevant) WHERE NOT conflict OR NOT any_clean""", "relevant")


def _best_sql(value: str) -> str:
    return with_ctes(f"""SELECT {_COLS} FROM relevant QUALIFY row_number() OVER
      (PARTITION BY query_id, store_slug ORDER BY {value}, seq) = 1""", "relevant")


SQL = {
    "relevant_offers": with_ctes(f"SELECT {_COLS}, query FROM relevant", "relevant"),
    "variant_filter": _variant_sql("query_id"),
    "variant_filter_per_store": _variant_sql("query_id, store_slug"),
    "best_per_store_unit": _best_sql("pack_unit"),
    "best_per_store_price": _best_sql("price"),
    "search_offers": with_ctes(f"""
      SELECT {_COLS}, subscribe_price, package_size, product_url, is_available, ean,
        row_number() OVER (PARTITION BY query_id ORDER BY price, seq) AS position FROM searched""", "searched"),
    "coverage_report": with_ctes("""
      SELECT store_slug, count(DISTINCT query_id) AS queries_with_results, count(*) AS valid_results,
        count(package_size) AS with_package_size, count(net_weight) AS with_net_weight,
        (SELECT count(*) FROM queries) AS queries,
        CAST(floor(count(package_size) / count(*) * 100 + 0.5) AS INTEGER) AS package_size_percent,
        CAST(floor(count(net_weight) / count(*) * 100 + 0.5) AS INTEGER) AS net_weight_percent
      FROM offers WHERE price > 0 GROUP BY store_slug""", "offers", "queries"),
    "missing_quantity_names": with_ctes("""
      SELECT store_slug, query_id, seq, product_name FROM offers
      WHERE price > 0 AND package_size IS NULL AND net_weight IS NULL
      QUALIFY row_number() OVER (PARTITION BY store_slug, query_id ORDER BY seq) <= 5""", "offers"),
    "scraper_health": with_ctes(f"SELECT *, {_HEALTH} AS health FROM ({_OUTCOMES})", "runs"),
    "health_summary": with_ctes(
        f"SELECT {_HEALTH} AS health, count(*) AS stores FROM ({_OUTCOMES}) GROUP BY 1", "runs"),
}
