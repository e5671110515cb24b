"""Offers from captured payloads, and the lookups around a search."""

from pyspark.sql import functions as F

from shelfprice.adapter import captures as cap
from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.operators import resolve
from shelfprice.plans.matching import match_names
from shelfprice.sources import html_offers as html
from shelfprice.sources.extract import merge_indexes as merge
from shelfprice.sources.json_offers import extract_json_offers
from shelfprice.sources.json_specs import EMBEDDED_SPECS, JSON_SPECS, RANKS

_COLS = [
    "capture_id", "store_slug", "seq", "product_name", "price", "product_url", "is_available", "package_size",
    "net_weight", "net_weight_unit",
]


def json_offers(spark, d):
    offers, _ = extract_json_offers(cap.json_captures(spark, d, cap.JSON_SHOPS), JSON_SPECS, RANKS)
    return offers.select(*_COLS)


def embedded_json_offers(spark, d):
    offers, _ = extract_json_offers(cap.json_captures(spark, d, cap.EMBEDDED_SHOPS), EMBEDDED_SPECS, RANKS)
    return offers.select(*_COLS)


def payload_rejects(spark, d):
    """A third of the payloads is cut short; strict mode also rejects one wrong element type."""
    rows = cap.json_captures(spark, d, ["nappy"])
    third = F.col("capture_id") % 3
    broken = rows.withColumn(
        "body",
        F.when(third == 0, F.substring("body", 1, 5))
        .when(third == 1, F.regexp_replace("body", '"price_amount":0.0', '"price_amount":"free"'))
        .otherwise(F.col("body")),
    )
    _, loose = extract_json_offers(broken, JSON_SPECS, RANKS)
    _, strict = extract_json_offers(broken, JSON_SPECS, RANKS, strict=True)
    return loose.select("capture_id", F.lit("loose").alias("rule")).unionByName(
        strict.select("capture_id", F.lit("strict").alias("rule"))
    )


def html_tiles(spark, d):
    shops = [s for s in cap.HTML_SHOPS if s != "lidl"]
    offers, _ = html.extract_html_offers(cap.html_captures(spark, d, shops), html.HTML_SPECS, RANKS)
    return offers.select(*_COLS)


def ld_json_or_tiles(spark, d):
    return html.extract_page_or_ld_json(cap.html_captures(spark, d, ["lidl"]), RANKS).select(*_COLS)


_PAGE = html.PageSpec(
    "page", "Page", "html",
    {"name": [html.Pick("title")], "href": [html.Pick("a", "href")], "key": [html.Pick(attr="lang")]},
    lambda x: {"name": x["name"]},
)


def page_tiles(spark, d):
    """Title, language and first link of raw web pages, whole documents."""
    pages = t.table(spark, d, "pages").select(
        F.col("page_id").alias("capture_id"), F.lit("page").alias("store_slug"), F.lit(0).cast("long").alias("query_id"),
        F.col("html").alias("body"),
    )
    tile = F.get("_tiles", F.lit(0))
    return html.page_tiles(pages, [_PAGE]).select(
        F.col("capture_id").alias("page_id"), tile["name"].alias("title"), tile["key"].alias("lang"),
        tile["href"].alias("first_link"),
    )


def detail_price(spark, d):
    rows = html.extract_detail_price(cap.shop_detail_captures(spark, d))
    return rows.select("capture_id", "store_slug", "price", "is_available")


def listing_candidates(spark, d):
    return html.extract_listing(cap.listing_captures(spark, d)).select(
        "capture_id", "position", "product_name", "product_url"
    )


def listing_detail_join(spark, d):
    listing = html.extract_listing(cap.listing_captures(spark, d))
    details = html.extract_detail_price(cap.detail_captures(spark, d))
    rows = html.join_listing_with_detail(listing, details, RANKS)
    return rows.select(
        "capture_id", "seq", "product_name", "price", "subscribe_price", "is_available", "package_size"
    )


def merged_indexes(spark, d):
    """The available offers first, then all offers; the second list repeats URLs of the first."""
    offers = t.offers(spark, d).select("query_id", "seq", "product_url", "is_available")
    return merge(offers.filter("is_available"), offers).select("query_id", "position", "seq", "product_url")


def _reference_hits(spark, d):
    """Catalogue rows per query: every observed line of a product is a hit with a code and two names."""
    code = F.when(F.col("l_linenumber") == 1, F.lit("12-3")).otherwise(F.lpad(F.col("l_orderkey").cast("string"), 13, "0"))
    return t.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("query_id"), F.col("l_extendedprice").alias("scans"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("hit_id"), code.alias("code"),
        F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat(F.lit("Producto "), "l_suppkey")).alias("name_es"),
        F.when(F.col("l_linenumber") != 4, F.concat(F.lit("Product "), "l_suppkey")).alias("name"),
    )


def resolved_eans(spark, d):
    rows = resolve.resolve_eans(t.queries(spark, d), _reference_hits(spark, d))
    return rows.select("query_id", "canonical_name", F.array_join("eans", ",").alias("eans"))


def _tree(spark, d):
    """Brands as top categories, each with the part types as sub categories."""
    return t.table(spark, d, "part").groupBy("p_brand").agg(
        F.array_sort(F.collect_set(F.struct(
            F.concat_ws("/", "p_brand", "p_type").alias("id"), F.concat(F.col("p_type"), F.lit(" artículos")).alias("name")
        ))).alias("categories")
    ).select(
        F.col("p_brand").alias("position"), F.col("p_brand").alias("id"), F.concat(F.lit("Línea "), "p_brand").alias("name"),
        "categories",
    )


def _wishes(spark, d):
    """Queries that name a part type or a brand number."""
    key = F.col("p_partkey")
    return t.table(spark, d, "part").select(
        key.alias("query_id"),
        F.when(key % 3 == 0, F.concat(F.lower("p_type"), F.lit(" de x"))).when(
            key % 3 == 1, F.concat(F.lit("linea "), F.col("p_name"))
        ).otherwise(F.lit("zz nada")).alias("query"),
    )


def category_match(spark, d):
    return resolve.match_categories(_tree(spark, d), _wishes(spark, d))


def category_products(spark, d):
    """Products of each query's own brand category that share a word with the query."""
    parts = t.table(spark, d, "part")
    queries = parts.groupBy("p_name").agg(F.min("p_partkey").alias("query_id"), F.min("p_brand").alias("brand"))
    products = parts.select(
        F.col("p_partkey").alias("product_id"), F.col("p_partkey").alias("position"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("category_id"),
    )
    matched = queries.select("query_id", F.col("brand").alias("category_id"), F.lit(1).alias("rank"))
    rows = resolve.category_products(matched, products, queries.select("query_id", F.col("p_name").alias("query")))
    return rows.select("query_id", "product_id", "name")


def ean_first(spark, d):
    """Exact barcode hits replace the text hits of a query."""
    offers = t.offers(spark, d).select("query_id", "seq", "store_slug", "ean", "price")
    wanted = t.queries(spark, d).withColumn(
        "eans", F.array(F.lpad(F.col("query_id").cast("string"), 13, "0"))
    )
    hits = resolve.match_by_ean(
        wanted.select("query_id", "eans"), offers.filter("ean is not null").drop("query_id")
    )
    return resolve.ean_first(hits, offers.filter("ean is null").select(*hits.columns))


def _relaxed(ladder, suffix):
    def run(spark, d):
        parts = t.table(spark, d, "part")
        items = parts.select(F.col("p_partkey").alias("item_id"), F.concat_ws(" ", "p_name", "p_type").alias("product_name"))
        words = [F.col("p_name"), F.lit(suffix)] if ladder == "prefix" else [F.lit(suffix), F.col("p_name")]
        queries = parts.select(F.col("p_partkey").alias("query_id"), F.concat_ws(" ", *words).alias("query"))
        rows = resolve.relaxed_match(queries, items, ladder)
        return rows.select("query_id", "step", "item_id")

    return run


def pair_inputs(spark, d):
    """A query of a brand and a word, and a title, for every part."""
    parts = t.table(spark, d, "part")
    queries = parts.select(
        F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_brand", "p_name").alias("query")
    )
    names = parts.select(
        F.col("p_partkey").alias("name_id"),
        F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" talla "), F.col("p_size").cast("string")).alias("name"),
    )
    return queries, names


def relevant_pairs(spark, d):
    """Every query of a brand and a word against every title, by shared pieces."""
    return match_names(*pair_inputs(spark, d)).select("query_id", "name_id")


QUERIES = {
    f.__name__: f
    for f in [
        json_offers, embedded_json_offers, payload_rejects, html_tiles, ld_json_or_tiles, page_tiles, detail_price,
        listing_candidates, listing_detail_join, merged_indexes, resolved_eans, category_match, category_products,
        ean_first, relevant_pairs,
    ]
} | {"relaxed_match": _relaxed("prefix", "nuevo azul"), "relaxed_match_tail": _relaxed("tail", "nuevo")}


_LISTED = """SELECT p_partkey AS capture_id, k,
    CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY k) - 1 AS INTEGER) AS position,
    p_name || ' talla 5 modelo ' || k AS product_name,
    'https://www.amazon.es/dp/' || lpad(CAST(k AS VARCHAR), 2, '0') || lpad(CAST(p_partkey AS VARCHAR), 8, '0')
      AS product_url, p_retailprice, p_partkey % 40 + 2 AS n, p_name
  FROM part, (SELECT unnest([0, 1, 2, 5, 6, 7, 8, 9]) AS k)"""


def _relaxed_sql(step: int) -> str:
    return f"""
      SELECT query_id, {step} AS step, item_id FROM (
        SELECT q.p_partkey AS query_id, i.p_partkey AS item_id,
          row_number() OVER (PARTITION BY q.p_partkey ORDER BY i.p_partkey) AS rn
        FROM part q JOIN part i
          ON list_has_all(string_split(i.p_name || ' ' || lower(i.p_type), ' '), string_split(q.p_name, ' '))) WHERE rn <= 5"""


SQL = {
    "json_offers": cap.expected_offers(cap.JSON_SHOPS),
    "embedded_json_offers": cap.expected_offers(cap.EMBEDDED_SHOPS),
    "payload_rejects": """
      SELECT p_partkey AS capture_id, 'loose' AS rule FROM part WHERE p_partkey % 3 = 0
      UNION ALL SELECT p_partkey, 'strict' FROM part WHERE p_partkey % 3 < 2""",
    "html_tiles": cap.expected_offers([s for s in cap.HTML_SHOPS if s != "lidl"]),
    "ld_json_or_tiles": cap.expected_offers(["lidl"]),
    "detail_price": """
      SELECT p_partkey AS capture_id, (['carrefour', 'elcorteingles', 'pccomponentes'])[CAST(p_partkey % 3 AS INTEGER) + 1]
        AS store_slug, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE 1000.5::DOUBLE + (p_partkey % 40 + 2) * 10 END
        AS price, p_partkey % 3 <> 1 AS is_available
      FROM part""",
    "listing_candidates": f"SELECT capture_id, position, product_name, product_url FROM ({_LISTED})",
    "listing_detail_join": f"""
      SELECT capture_id, CAST(19000000 + position AS BIGINT) AS seq,
        CASE WHEN k = 0 THEN product_name ELSE p_name || ' talla 5 ' || n || ' uds' END AS product_name,
        CASE WHEN k = 5 THEN floor(p_retailprice + k) + 0.5::DOUBLE
          ELSE floor((p_retailprice + k) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE END AS price,
        CASE WHEN k = 2 THEN floor((p_retailprice + k - 1) * 100 + 0.5::DOUBLE) / 100.0::DOUBLE END AS subscribe_price,
        k <> 6 AS is_available, CASE WHEN k <> 0 THEN CAST(n AS INTEGER) END AS package_size
      FROM ({_LISTED}) WHERE k IN (0, 2, 5, 6, 8)""",
    "merged_indexes": with_ctes("""
      SELECT query_id, position, seq, product_url FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY part, seq) AS position FROM (
          SELECT query_id, seq, product_url, part FROM (
            SELECT *, 0 AS part FROM offers WHERE is_available UNION ALL SELECT *, 1 AS part FROM offers)
          QUALIFY row_number() OVER (PARTITION BY query_id, product_url ORDER BY part, seq) = 1))
      WHERE position <= 5""", "offers"),
    "resolved_eans": with_ctes("""
      SELECT q.query_id, coalesce(any_value(nullif(name_es, '')) FILTER (rn = 1), any_value(name) FILTER (rn = 1), query)
          AS canonical_name,
        coalesce(array_to_string((list(code ORDER BY rn) FILTER (regexp_full_match(code, '[0-9]{8,14}')))[1:5], ','), '') AS eans
      FROM queries q LEFT JOIN (
        SELECT l_partkey AS query_id,
          CASE WHEN l_linenumber = 1 THEN '12-3' ELSE lpad(CAST(l_orderkey AS VARCHAR), 13, '0') END AS code,
          CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'Producto ' || l_suppkey END AS name_es,
          CASE WHEN l_linenumber <> 4 THEN 'Product ' || l_suppkey END AS name,
          row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC,
            l_orderkey || '-' || l_linenumber || '-' || l_suppkey) AS rn
        FROM lineitem QUALIFY rn <= 10) h USING (query_id) GROUP BY q.query_id, query""", "queries"),
    "category_match": """
      WITH nodes AS (
        SELECT DISTINCT p_brand AS brand, 0 AS sub, p_brand AS category_id, 'linea ' || lower(p_brand) AS name FROM part
        UNION SELECT DISTINCT p_brand, 1, p_brand || '/' || p_type, lower(p_type) || ' articulos' FROM part),
      wishes AS (SELECT p_partkey AS query_id, unnest(list_filter(string_split(CASE p_partkey % 3
        WHEN 0 THEN lower(p_type) || ' de x' WHEN 1 THEN 'linea ' || p_name ELSE 'zz nada' END, ' '),
        lambda w: len(w) >= 3)) AS word FROM part)
      SELECT query_id, category_id, CAST(rank AS INTEGER) AS rank FROM (
        SELECT query_id, category_id, row_number() OVER (PARTITION BY query_id ORDER BY brand, sub, category_id) AS rank
        FROM (SELECT DISTINCT query_id, category_id, brand, sub FROM wishes JOIN nodes ON contains(name, word)))
      WHERE rank <= 3""",
    "category_products": """
      WITH q AS (SELECT p_name, min(p_partkey) AS query_id, min(p_brand) AS brand FROM part GROUP BY p_name)
      SELECT query_id, p.p_partkey AS product_id, p.p_name AS name FROM q JOIN part p ON p.p_brand = q.brand
      WHERE list_bool_or(list_transform(list_filter(string_split(q.p_name, ' '), lambda w: len(w) >= 2),
        lambda w: contains(p.p_name, w)))
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY p.p_partkey) <= 10""",
    "page_tiles": """
      SELECT page_id, replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') AS title,
        regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
        nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS first_link FROM pages""",
    "ean_first": with_ctes("""
      SELECT query_id, seq, store_slug, ean, price FROM offers WHERE ean IS NOT NULL
      UNION ALL SELECT query_id, seq, store_slug, ean, price FROM offers WHERE ean IS NULL
        AND query_id NOT IN (SELECT query_id FROM offers WHERE ean IS NOT NULL)""", "offers"),
    "relaxed_match": _relaxed_sql(2),
    "relaxed_match_tail": _relaxed_sql(1),
    "relevant_pairs": """
      SELECT q.p_partkey AS query_id, n.p_partkey AS name_id FROM part q JOIN part n
        ON contains(n.p_name, split_part(q.p_name, ' ', 1)) AND contains(n.p_name, split_part(q.p_name, ' ', 2))
        AND regexp_matches(lower(n.p_brand) || ' talla ' || n.p_size,
          '(^|[^0-9-])t?' || regexp_extract(q.p_brand, '[0-9]+') || '([^0-9-]|$)')""",
}
