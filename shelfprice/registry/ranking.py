"""Comparable prices and rankings."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import EFFECTIVE, WITH_SHIPPING, comparable, votes, with_ctes
from shelfprice.functions import pricing
from shelfprice.operators import history, offers

RANKING_COLUMNS = [
    "product_id", "product_slug", "position", "is_best", "store_id", "store_name", "price",
    "subscribe_price", "effective_price", "mode", "unit_price", "lowest_unit_price", "mode_header",
    "quantity_label", "shipping_label", "unit_price_label", "header_suffix", "scraped_at",
]


def price_ranking(spark, d):
    ranked = history.price_ranking(t.observations(spark, d), t.stores(spark, d), t.products(spark, d))
    return ranked.select(*RANKING_COLUMNS)


def comparison_mode(spark, d):
    return offers.comparison_mode(
        t.observations(spark, d).select("product_id", "package_size", "net_weight_unit"), ["product_id"]
    )


def lowest_unit_price(spark, d):
    rows = history.latest_per_product_store(t.observations(spark, d), available_only=True)
    return offers.lowest_unit_price(rows, ["product_id"], shipping=False)


def _search_rows(spark, d):
    """Current prices as search results: the product is the query, one row per store."""
    latest = history.latest_per_product_store(t.observations(spark, d), available_only=True)
    return latest.select(
        F.col("product_id").alias("query_id"), F.col("store_id").alias("seq"),
        F.concat(F.lit("store-"), "store_id").alias("store_slug"), F.col("price").cast("double").alias("price"),
        F.col("subscribe_price").cast("double").alias("subscribe_price"), "package_size", "net_weight",
        "net_weight_unit", "shipping_cost",
    )


def _ranked(sort):
    def run(spark, d):
        ranked = offers.rank_offers(_search_rows(spark, d), sort=sort)
        return ranked.select(
            "query_id", "store_slug", "position", "mode", "effective_price", "unit_price",
            "is_best_unit", "is_best_price",
        )

    return run


def raw_price_best(spark, d):
    """Best flag by plain price where nothing has a unit price (rows without any quantity)."""
    bare = _search_rows(spark, d).withColumns({
        "package_size": F.lit(None).cast("int"), "net_weight": F.lit(None).cast("double"),
    })
    ranked = offers.rank_offers(bare, sort="price")
    return ranked.select("query_id", "store_slug", "position", "mode", "is_best_price", "is_best_unit")


def stores_found(spark, d):
    return offers.stores_found(t.offers(spark, d))


QUERIES = {
    "price_ranking": price_ranking,
    "comparison_mode": comparison_mode,
    "lowest_unit_price": lowest_unit_price,
    "search_ranking_unit": _ranked("unit"),
    "search_ranking_total": _ranked("total"),
    "raw_price_best": raw_price_best,
    "stores_found": stores_found,
}


def euro_sql(value: str, digits: int = 2) -> str:
    """Spanish money text of a number below 10 000 (no thousands mark) or above."""
    number = f"CAST(CAST({value} AS VARCHAR) AS DECIMAL(30,{digits}))"
    plain = f"replace(CAST({number} AS VARCHAR), '.', ',')"
    marked = (
        f"replace(replace(replace(format('{{:,.{digits}f}}', CAST({number} AS DOUBLE)), ',', '#'), '.', ','), '#', '.')"
    )
    return f"(CASE WHEN abs({number}) < 10000 THEN {plain} ELSE {marked} END || chr(160) || '€')"


def weight_sql(value: str, unit: str) -> str:
    """Weight label of whole numbers below 1000."""
    return f"CASE WHEN {unit} = 'g' THEN CAST(CAST({value} AS INTEGER) AS VARCHAR) || 'g' ELSE CAST(CAST({value} AS INTEGER) AS VARCHAR) || ' ml' END"


_RANKED = {
    "live": f"""SELECT l.*, s.name AS store_name, s.free_shipping_threshold, s.shipping_note,
        p.slug AS product_slug, v.mode, {EFFECTIVE} AS base, {WITH_SHIPPING} AS effective_price
      FROM latest l JOIN stores s USING (store_id) JOIN products p USING (product_id)
        JOIN ({votes('latest', 'product_id')}) v USING (product_id) WHERE p.is_active""",
    "priced": f"SELECT *, {comparable('effective_price')} AS unit_price, {comparable('base')} AS plain FROM live",
}

_SHIPPING = f"""CASE WHEN shipping_cost = 0 THEN 'Gratis' WHEN shipping_cost > 0 THEN {euro_sql('shipping_cost')}
  WHEN free_shipping_threshold IS NOT NULL THEN 'Gratis desde ' || {euro_sql('free_shipping_threshold')}
  WHEN shipping_note <> '' THEN shipping_note ELSE '—' END"""

_RESULTS = f"""SELECT product_id AS query_id, store_id AS seq, 'store-' || store_id AS store_slug, mode,
    CAST(price AS DOUBLE) AS price, package_size, net_weight, {WITH_SHIPPING} AS effective_price
  FROM latest JOIN ({votes('latest', 'product_id')}) USING (product_id)"""


def _ranked_sql(order: str) -> str:
    return with_ctes(f"""
      SELECT query_id, store_slug, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS position, mode,
        effective_price, unit_price,
        coalesce(abs(unit_price - min(unit_price) OVER (PARTITION BY query_id)) < 0.0001, false) AS is_best_unit,
        min(unit_price) OVER (PARTITION BY query_id) IS NULL
          AND price = min(price) OVER (PARTITION BY query_id) AS is_best_price
      FROM priced""", "latest", extra={
        "results": _RESULTS,
        "priced": f"SELECT *, {comparable('effective_price')} AS unit_price FROM results",
    })


SQL = {
    "price_ranking": with_ctes(f"""
      SELECT product_id, product_slug, row_number() OVER w AS position, row_number() OVER w = 1 AS is_best,
        store_id, store_name, price, subscribe_price, effective_price, mode, unit_price,
        min(plain) OVER (PARTITION BY product_id) AS lowest_unit_price,
        CASE mode WHEN 'per100g' THEN '€/kg' WHEN 'per100ml' THEN '€/l' WHEN 'perUnit' THEN '€/ud'
          ELSE '€/pack' END AS mode_header,
        CASE WHEN net_weight IS NOT NULL THEN CASE WHEN package_size > 1
            THEN package_size || '×' || {weight_sql('net_weight', 'net_weight_unit')}
            ELSE {weight_sql('net_weight', 'net_weight_unit')} END
          WHEN package_size IS NOT NULL THEN package_size || ' uds' ELSE '—' END AS quantity_label,
        {_SHIPPING} AS shipping_label,
        coalesce(CASE WHEN mode = 'perUnit' THEN {euro_sql('unit_price', 3)} ELSE {euro_sql('unit_price')} END, '—')
          AS unit_price_label,
        CASE mode WHEN 'per100g' THEN 'por kg' WHEN 'per100ml' THEN 'por litro' WHEN 'perUnit' THEN 'por ud.'
          ELSE '' END AS header_suffix, scraped_at
      FROM priced WINDOW w AS (PARTITION BY product_id ORDER BY unit_price NULLS LAST,
        CASE WHEN unit_price IS NULL THEN effective_price END NULLS LAST, store_id)""",
        "stores", "products", "latest", extra=_RANKED),
    "comparison_mode": with_ctes(
        f"SELECT product_id, votes_g, votes_ml, votes_unit, mode FROM ({votes('observations', 'product_id')})",
        "observations"),
    "lowest_unit_price": with_ctes(f"""
      SELECT product_id, any_value(mode) AS mode, min({comparable(EFFECTIVE)}) AS lowest_unit_price
      FROM latest JOIN ({votes('latest', 'product_id')}) USING (product_id) GROUP BY product_id""", "latest"),
    "search_ranking_unit": _ranked_sql(
        "unit_price NULLS LAST, CASE WHEN unit_price IS NULL THEN effective_price END NULLS LAST, seq"),
    "search_ranking_total": _ranked_sql("effective_price NULLS LAST, seq"),
    "raw_price_best": with_ctes(f"""
      SELECT query_id, store_slug, row_number() OVER (PARTITION BY query_id ORDER BY price, seq) AS position, mode,
        (mode <> 'rawPrice') AND price = min(price) OVER (PARTITION BY query_id) AS is_best_price,
        (mode = 'rawPrice') AND effective_price - min(effective_price) OVER (PARTITION BY query_id) < 0.0001
          AS is_best_unit
      FROM results""", "latest", extra={"results": f"""
        SELECT product_id AS query_id, store_id AS seq, 'store-' || store_id AS store_slug,
          CAST(price AS DOUBLE) AS price, {WITH_SHIPPING} AS effective_price,
          CASE product_id % 3 WHEN 0 THEN 'per100g' WHEN 1 THEN 'per100ml' ELSE 'rawPrice' END AS mode
        FROM latest"""}),
    "stores_found": with_ctes("""
      SELECT query_id, count(*) AS results, count(DISTINCT store_slug) AS stores_found
      FROM offers GROUP BY query_id""", "offers"),
}
