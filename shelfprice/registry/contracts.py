"""Bad input, repeated keys and other contracts of the operators, made from the given tables."""

from pyspark.sql import functions as F

from shelfprice.adapter import captures as cap
from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.functions.quantity import with_quantity
from shelfprice.functions.relevance import is_relevant
from shelfprice.operators import dml, ops, validate
from shelfprice.operators import offers as offer_ops
from shelfprice.plans import jobs
from shelfprice.plans.search import relevant_offers
from shelfprice.plans.search import search_with_codes as coded_search
from shelfprice.registry.extraction import _reference_hits
from shelfprice.sources import html_offers as html
from shelfprice.sources import tables as stored
from shelfprice.sources.extract import extract_offers, stored_tiles
from shelfprice.sources.json_specs import RANKS
from shelfprice.streaming.runs import work_dir

MOMENT = "2003-01-01 06:00:00"
_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def title_quantity_extreme(spark, d):
    """Titles with counts and weights beyond any pack; the readers after them have their turn."""
    n = F.col("l_orderkey").cast("string")
    title = (
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("Pañales 99999999"), n, F.lit("999 uds")))
        .when(F.col("l_linenumber") == 2, F.concat(F.lit("Pack de 99999999"), n, F.lit("999")))
        .when(F.col("l_linenumber") == 3, F.concat(F.lit("Atun 99999999"), n, F.lit("999 x 80 g")))
        .when(F.col("l_linenumber") == 4, F.concat(F.lit("Agua 99999999"), n, F.lit("999999 kg")))
        .when(F.col("l_linenumber") == 5, F.concat(F.lit("Papel 99999999"), n, F.lit("999 rollos")))
        .otherwise(F.concat(F.lit("Toallitas "), F.col("l_suppkey").cast("string"), F.lit(" uds")))
    )
    rows = t.table(spark, d, "lineitem").select(*_LINE, title.alias("title"))
    return with_quantity(rows, "title").select(*_LINE, "quantity.*")


def detail_rejects(spark, d):
    """Product pages of which every third can't be parsed and every third has no price."""
    third = F.col("capture_id") % 3
    pages = cap.shop_detail_captures(spark, d).withColumn(
        "body", F.when(third == 0, F.concat(F.lit("<![foo[x]]>"), "body")).when(third == 1, F.lit("<p>agotado</p>")).otherwise(F.col("body"))
    )
    return html.detail_rejects(pages).select("capture_id", "store_slug", "broken_rule")


def _dear_matches(spark, d):
    """Matches of which those of every seventh product have a price beyond the column."""
    price = F.when(F.col("product_id") % 7 == 0, F.lit(123456789012.0)).otherwise(F.col("price").cast("double"))
    return t.observations(spark, d).drop("observation_id").withColumn("price", price)


def observation_price_rejects(spark, d):
    matches = _dear_matches(spark, d)
    kept = dml.observation_rows(matches, MOMENT).select("product_id", F.lit("kept").alias("outcome"))
    gone = dml.observation_rejects(matches).select("product_id", F.array_join("broken_rules", ",").alias("outcome"))
    return kept.unionByName(gone).groupBy("product_id", "outcome").agg(F.count("*").alias("n"))


def partial_update_repeated(spark, d):
    """Two validated changes of every alert; the one of the lower target counts, the other is a reject."""
    alerts = t.alerts(spark, d)
    change = F.explode(F.array(F.lit(2), F.lit(1), F.lit(0))).alias("turn")
    changes = alerts.select("alert_id", "user_id", change).withColumn(
        "target_price", (F.col("turn") * F.lit(9.99)).cast("decimal(10,2)")
    )
    valid, _ = validate.validate_alerts(changes, partial=True)
    table, rejected = dml.partial_update(alerts, valid, "alert_id", ["target_price"], owner="user_id", order=[F.col("turn")])
    return table.select("alert_id", "target_price", F.lit("table").alias("part")).unionByName(
        rejected.select("alert_id", "target_price", F.lit("rejected").alias("part"))
    )


def product_changes(spark, d):
    """Changes of products that name only what changes; a short name or a bad barcode stops a change."""
    key = F.col("product_id")
    changes = t.products(spark, d).select(
        "product_id", F.when(key % 5 == 0, "x").when(key % 5 == 1, F.concat(F.lit("Nuevo "), "name")).alias("name"),
        *[F.lit(None).cast("string").alias(c) for c in ("slug", "description", "image_url", "category", "brand")],
        F.when(key % 7 == 0, "12").alias("ean"),
    )
    valid, _ = validate.validate_products(changes, partial=True)
    table, _ = dml.partial_update(t.products(spark, d), valid, "product_id", ["name", "ean"], order=[F.col("name")])
    return table.select("product_id", "name", "ean")


def insert_conflicts(spark, d):
    """New products in pairs of one slug: the lower number goes in, the other is a conflict, as are known slugs."""
    products = t.products(spark, d)
    fresh = products.withColumns({
        "slug": F.when(F.col("product_id") % 3 == 0, F.col("slug")).otherwise(F.concat(F.col("slug"), F.lit("-new"))),
        "product_id": F.explode(F.array(F.col("product_id") + 10_000_000, F.col("product_id") + 20_000_000)),
    })
    table, conflicts = dml.insert_unique(products, fresh, ["slug"], [F.col("product_id").asc()])
    kept = table.filter("product_id >= 10000000").select("product_id", F.lit("inserted").alias("outcome"))
    return kept.unionByName(conflicts.select("product_id", F.lit("conflict").alias("outcome")))


def register_new_rows(spark, d):
    """Rows that registrations insert when two users share each page, counted per table."""
    key = F.col("c_custkey")
    page = F.concat(F.lit("https://shop.example/p/"), F.floor(key / 2).cast("string"))
    requests = t.table(spark, d, "customer").select(
        key.alias("request_id"), key.alias("user_id"), F.lit("supplier-000000001").alias("store_slug"), page.alias("url"),
        F.when(key % 3 == 0, F.lit(5.0)).alias("target_price"),
    )
    stores = t.stores(spark, d).withColumn("is_active", F.lit(True))
    job = jobs.register_by_url(requests, t.products(spark, d), stores, t.tracked(spark, d), t.alerts(spark, d), MOMENT)
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, rows in sorted(job.inserted.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def best_per_store_recaptured(spark, d):
    """Every offer captured twice, the later capture under another name: the first capture counts."""
    offers = t.offers(spark, d).withColumn("capture_id", F.explode(F.array(F.lit(2), F.lit(1))))
    relevant = relevant_offers(t.queries(spark, d), offers)
    return offer_ops.best_per_store(relevant).select("query_id", "store_slug", "seq", "capture_id")


def search_with_codes(spark, d):
    """Search with the barcodes that the reference catalogue gives first."""
    offers = t.offers(spark, d).withColumn("ean", F.when(F.col("ean").isNotNull(), F.lpad(F.split("seq", "-")[0], 13, "0")))
    rows = coded_search(t.queries(spark, d), _reference_hits(spark, d), offers)
    return rows.select("query_id", "store_slug", "seq", "ean", "position")


def coverage_all_stores(spark, d):
    """Coverage of all offers over the stores and as many new ones, which have zeros and no percentages."""
    valid, _ = validate.validate_offers(t.offers(spark, d))
    stores = t.stores(spark, d)
    new = stores.withColumn("slug", F.concat(F.lit("new-"), "slug"))
    return ops.coverage_report(valid, t.queries(spark, d), stores.unionByName(new))


def _monthly(spark, d):
    """Observations, moved to the first day of their month."""
    return t.observations(spark, d).withColumn("scraped_at", F.date_trunc("month", "scraped_at"))


def stored_observations(spark, d):
    """Observations written in daily folders and read back."""
    path = work_dir(spark, "tables")
    stored.append_observations(_monthly(spark, d), path)
    rows = stored.read_tables(spark, path, ["observations"])["observations"]
    return rows.groupBy("scrape_date").agg(F.count("*").alias("n"), F.sum("price").alias("total"))


def append_twice(spark, d):
    """Observations appended twice, the second time with a new one for each of every fifth product: all stand there once."""
    path = work_dir(spark, "tables")
    rows = _monthly(spark, d)
    stored.append_observations(rows, path)
    new = rows.filter("product_id % 5 = 0").withColumn("observation_id", F.concat(F.lit("new-"), "observation_id"))
    stored.append_observations(rows.unionByName(new), path)
    held = stored.read_observations(spark, path)
    return held.groupBy("scrape_date").agg(
        F.count("*").alias("n"), F.countDistinct("observation_id").alias("different"), F.sum("price").alias("total")
    )


def html_implied_tags(spark, d):
    """Result pages as lists without end tags."""
    spec = html.PageSpec(
        "list", "List", "li.t", {"name": [html.Pick("p.n")], "price": [html.Pick("p.c")]}, lambda x: {"name": x["name"], "price": x["price"]},
    )
    body = F.concat(
        F.lit("<ul><li class=t><p class=n>"), "p_name", F.lit("<p class=c>"), F.col("p_size").cast("string"),
        F.lit("<li class=t><p class=n>"), "p_brand", F.lit("<div>x</div><p class=c>"), F.col("p_partkey").cast("string"), F.lit("</ul>"),
    )
    pages = stored.spread(t.table(spark, d, "part")).select(
        F.col("p_partkey").alias("capture_id"), F.lit("list").alias("store_slug"), F.lit(0).cast("long").alias("query_id"), body.alias("body"),
    )
    tile = F.explode("_tiles").alias("tile")
    return html.page_tiles(pages, [spec]).select("capture_id", tile).select("capture_id", "tile.name", "tile.price")


def uncapped_offers(spark, d):
    """Eight equal lists in one payload give all their offers where the shop's limit is off."""
    rows = cap.html_captures(spark, d, ["ahorramas"])
    many = rows.withColumn("body", F.repeat("body", F.lit(8)))
    tiles = stored_tiles(many, work_dir(spark, "tiles"))
    capped, _ = extract_offers(many, tiles=tiles)
    all_offers, _ = extract_offers(many, capped=False, tiles=tiles)
    return capped.groupBy("capture_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("capped")).unionByName(
        all_offers.groupBy("capture_id").agg(F.count("*").alias("n")).withColumn("rule", F.lit("all"))
    )


def relevance_rules(spark, d):
    """Sized, discriminating and five-word queries against titles that meet and miss them."""
    kind = F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("kind")
    name, key = F.col("p_name"), F.col("p_partkey")
    size = (key % 4 + 1).cast("string")
    query = (
        F.when(key % 3 == 0, F.concat(F.lit("pañales "), name, F.lit(" talla "), size))
        .when(key % 3 == 1, F.concat(name, F.lit(" Chocolate")))
        .otherwise(F.concat(name, F.lit(" extra grande familiar azul")))
    )
    rows = t.table(spark, d, "part").select(key, name, query.alias("query"), size.alias("size"), kind)
    k = F.col("kind")
    title = F.concat(
        name,
        F.when(k == 0, F.concat(F.lit(" talla "), "size")).when(k == 1, F.concat(F.lit(" T"), "size", F.lit(" 40 uds")))
        .when(k == 2, F.concat(F.lit(" 3-"), "size", F.lit(" kg"))).when(k == 3, F.lit(" con chocolate negro extra grande"))
        .when(k == 4, F.lit(" extra grande familiar")).otherwise(F.lit(" azul familiar grande extra talla 9")),
    )
    return rows.select("p_partkey", "kind", is_relevant(title, F.col("query")).alias("relevant"))


QUERIES = {
    f.__name__: f
    for f in [
        title_quantity_extreme, detail_rejects, observation_price_rejects, partial_update_repeated, product_changes,
        insert_conflicts, register_new_rows, best_per_store_recaptured, search_with_codes, coverage_all_stores,
        stored_observations, append_twice, html_implied_tags, uncapped_offers, relevance_rules,
    ]
}

SQL = {
    "title_quantity_extreme": """
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CASE WHEN l_linenumber > 5 THEN CAST(l_suppkey AS INTEGER) END AS package_size,
        CASE WHEN l_linenumber = 3 THEN 80.0::DOUBLE END AS net_weight, CASE WHEN l_linenumber = 3 THEN 'g' END AS net_weight_unit
      FROM lineitem""",
    "detail_rejects": """
      SELECT p_partkey AS capture_id, (['carrefour', 'elcorteingles', 'pccomponentes'])[CAST(p_partkey % 3 AS INTEGER) + 1]
        AS store_slug, CASE p_partkey % 3 WHEN 0 THEN 'unreadable' ELSE 'price' END AS broken_rule
      FROM part WHERE p_partkey % 3 <> 2""",
    "observation_price_rejects": with_ctes("""
      SELECT product_id, CASE WHEN product_id % 7 = 0 THEN 'price_range' ELSE 'kept' END AS outcome, count(*) AS n
      FROM observations GROUP BY ALL""", "observations"),
    "partial_update_repeated": with_ctes("""
      SELECT alert_id, CAST(9.99 AS DECIMAL(10,2)) AS target_price, 'table' AS part FROM alerts
      UNION ALL SELECT alert_id, CAST(19.98 AS DECIMAL(10,2)), 'rejected' FROM alerts""", "alerts"),
    "product_changes": with_ctes("""
      SELECT product_id, CASE WHEN product_id % 5 = 1 AND product_id % 7 <> 0 THEN 'Nuevo ' || name ELSE name END AS name, ean
      FROM products""", "products"),
    "insert_conflicts": with_ctes("""
      SELECT product_id + 10000000 AS product_id, CASE WHEN product_id % 3 = 0 THEN 'conflict' ELSE 'inserted' END AS outcome
      FROM products UNION ALL SELECT product_id + 20000000, 'conflict' FROM products""", "products"),
    "register_new_rows": """
      SELECT 'alerts' AS name, count(*) FILTER (c_custkey % 3 = 0) AS n FROM customer
      UNION ALL SELECT 'products', count(DISTINCT c_custkey // 2) FROM customer
      UNION ALL SELECT 'tracked', count(*) FROM customer""",
    "best_per_store_recaptured": with_ctes("""
      SELECT query_id, store_slug, seq, 1 AS capture_id FROM relevant QUALIFY row_number() OVER
        (PARTITION BY query_id, store_slug ORDER BY pack_unit, seq) = 1""", "relevant"),
    "coverage_all_stores": with_ctes("""
      , c AS (SELECT store_slug, count(DISTINCT query_id) AS q, count(*) AS v, count(package_size) AS s, count(net_weight) AS w
        FROM offers WHERE price > 0 GROUP BY 1),
      every AS (SELECT slug FROM stores UNION ALL SELECT 'new-' || slug FROM stores)
      SELECT slug AS store_slug, coalesce(q, 0) AS queries_with_results, coalesce(v, 0) AS valid_results,
        coalesce(s, 0) AS with_package_size, coalesce(w, 0) AS with_net_weight, (SELECT count(*) FROM queries) AS queries,
        CAST(floor(s / v * 100 + 0.5) AS INTEGER) AS package_size_percent,
        CAST(floor(w / v * 100 + 0.5) AS INTEGER) AS net_weight_percent
      FROM every LEFT JOIN c ON slug = c.store_slug""", "offers", "queries", "stores"),
    "stored_observations": with_ctes("""
      SELECT CAST(date_trunc('month', scraped_at) AS DATE) AS scrape_date, count(*) AS n, sum(price) AS total FROM observations
      GROUP BY 1""", "observations"),
    "append_twice": with_ctes("""
      SELECT CAST(date_trunc('month', scraped_at) AS DATE) AS scrape_date, count(*) AS n, count(*) AS different, sum(price) AS total
      FROM (SELECT scraped_at, price FROM observations UNION ALL SELECT scraped_at, price FROM observations WHERE product_id % 5 = 0)
      GROUP BY 1""", "observations"),
    "search_with_codes": with_ctes("""
      , hits AS (SELECT l_partkey AS query_id, l_extendedprice AS scans, l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS hit_id,
          CASE WHEN l_linenumber = 1 THEN '12-3' ELSE lpad(CAST(l_orderkey AS VARCHAR), 13, '0') END AS code FROM lineitem),
      best_hits AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY scans DESC, hit_id) <= 10),
      codes AS (SELECT query_id, code FROM best_hits WHERE regexp_full_match(code, '[0-9]{8,14}')
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY scans DESC, hit_id) <= 5),
      coded_offers AS (SELECT store_slug, seq, price, coalesce(subscribe_price, price) / coalesce(package_size, 1) AS pack_unit,
          regexp_matches(lower(product_name), 'con gas|carbonatada|carbonatado|con burbujas|sparkling') AS conflict,
          lpad(string_split(seq, '-')[1], 13, '0') AS ean
        FROM offers WHERE price > 0 AND ean IS NOT NULL),
      by_code AS (SELECT query_id, o.* FROM coded_offers o JOIN (SELECT DISTINCT query_id, code FROM codes) ON ean = code),
      by_text AS (SELECT query_id, store_slug, seq, price, pack_unit, conflict,
          CASE WHEN ean IS NOT NULL THEN lpad(string_split(seq, '-')[1], 13, '0') END AS ean FROM relevant r
        WHERE NOT EXISTS (SELECT 1 FROM by_code c WHERE c.query_id = r.query_id AND c.store_slug = r.store_slug)),
      found AS (SELECT query_id, store_slug, seq, price, pack_unit, conflict, ean FROM by_code UNION ALL
        SELECT query_id, store_slug, seq, price, pack_unit, conflict, ean FROM by_text),
      clean AS (SELECT * FROM (SELECT *, bool_or(NOT conflict) OVER (PARTITION BY query_id) AS any_clean FROM found)
        WHERE NOT (conflict AND any_clean)),
      firsts AS (SELECT * FROM clean QUALIFY row_number() OVER (PARTITION BY query_id, store_slug ORDER BY pack_unit, seq) = 1)
      SELECT query_id, store_slug, seq, ean, row_number() OVER (PARTITION BY query_id ORDER BY price, seq) AS position
      FROM firsts""", "relevant"),
    "html_implied_tags": """
      SELECT p_partkey AS capture_id, p_name AS name, CAST(p_size AS VARCHAR) AS price FROM part
      UNION ALL SELECT p_partkey, p_brand, CAST(p_partkey AS VARCHAR) FROM part""",
    "uncapped_offers": """
      SELECT p_partkey AS capture_id, unnest([5, 16]) AS n, unnest(['capped', 'all']) AS rule FROM part""",
    "relevance_rules": r"""
      WITH q AS (SELECT p_partkey, p_name, p_partkey % 4 + 1 AS size, unnest(range(6)) AS kind,
          CASE p_partkey % 3 WHEN 0 THEN p_name || ' talla ' || (p_partkey % 4 + 1) WHEN 1 THEN p_name || ' chocolate'
            ELSE p_name || ' extra grande familiar azul' END AS query FROM part),
      titled AS (SELECT *, lower(p_name || CASE kind WHEN 0 THEN ' talla ' || size WHEN 1 THEN ' t' || size || ' 40 uds'
          WHEN 2 THEN ' 3-' || size || ' kg' WHEN 3 THEN ' con chocolate negro extra grande' WHEN 4 THEN ' extra grande familiar'
          ELSE ' azul familiar grande extra talla 9' END) AS title FROM q),
      parts AS (SELECT *, regexp_replace(title, '[^a-z0-9]+', ' ', 'g') AS plain,
          list_filter(string_split(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w:
            NOT regexp_full_match(w, '[0-9]+') AND len(w) >= 2 AND w NOT IN ('talla', 'con')) AS words,
          list_distinct(list_filter(string_split(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'), ' '),
            lambda w: regexp_full_match(w, '[0-9]+'))) AS numbers,
          CASE WHEN regexp_matches(lower(query), '(^| )talla *[0-9]')
            THEN list_concat(regexp_extract_all(title || ' ', 'talla *([0-9]+)[^a-z0-9]', 1), regexp_extract_all(' ' || title || ' ', '[^a-z0-9]t([0-9]+)[^a-z0-9]', 1))
            ELSE regexp_extract_all(' ' || replace(title, ' ', '  ') || ' ', '[^0-9-]([0-9]+)[^0-9-]', 1) END AS held
        FROM titled)
      SELECT p_partkey, kind, len(list_filter(words, lambda w: contains(plain, w))) >= 0.8 * len(words)
        AND (NOT list_contains(words, 'chocolate') OR contains(plain, 'chocolate'))
        AND len(list_filter(numbers, lambda n: NOT list_contains(held, n))) = 0 AS relevant
      FROM parts""",
}
