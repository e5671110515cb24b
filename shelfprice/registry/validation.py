"""Row contracts over derived rows, some of them broken on purpose."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.operators import validate

_ID = ["query_id", "seq", "store_slug"]


def _offers(spark, d):
    """Offers of which some have no URL, an unknown unit or a negative subscription price."""
    return t.offers(spark, d).withColumns({
        "product_url": F.when(F.col("price") % 7 < 1, F.lit("")).otherwise(F.col("product_url")),
        "net_weight_unit": F.when(F.col("net_weight") == 20, F.lit("oz")).otherwise(F.col("net_weight_unit")),
        "subscribe_price": F.when(F.col("package_size") == 3, F.lit(-1.0)).otherwise(F.col("subscribe_price")),
    })


def offers_validated(spark, d):
    return validate.validate_offers(_offers(spark, d))[0].select(*_ID, "price")


def offers_rejected(spark, d):
    rows = validate.validate_offers(_offers(spark, d))[1]
    return rows.select(*_ID, F.array_join("broken_rules", ",").alias("broken_rules"))


def _observations(spark, d):
    """Observations with gaps that have defaults, and raw prices that are not in cents."""
    raw = t.table(spark, d, "lineitem")
    line = F.col("l_linenumber")
    return raw.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"),
        F.when(line == 1, F.col("l_extendedprice") / F.col("l_quantity")).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(line == 2, "EURO").when(line == 3, F.lit(None)).otherwise("EUR").alias("currency"),
        F.when(line == 4, "FILE").when(line == 5, F.lit(None)).otherwise("API").alias("source"),
        F.when(line == 6, "not a url").otherwise("https://shop.example/x").alias("url"),
        F.when(line % 2 == 0, F.lit(False)).alias("is_available"),
        F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey")).alias("product_id"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey")).alias("store_id"),
    )


def observations_validated(spark, d):
    rows = validate.validate_observations(_observations(spark, d))[0]
    return rows.select("observation_id", "price", "currency", "source", "is_available")


def observations_rejected(spark, d):
    rows = validate.validate_observations(_observations(spark, d))[1]
    return rows.select("observation_id", F.array_join("broken_rules", ",").alias("broken_rules"))


def _products(spark, d):
    """Products with names that are too short, slugs with spaces and short barcodes."""
    key = F.col("product_id")
    return t.products(spark, d).withColumns({
        "name": F.when(key % 11 == 0, "x").otherwise(F.col("name")),
        "slug": F.when(key % 13 == 0, F.concat(F.col("slug"), F.lit(" x"))).otherwise(F.col("slug")),
        "ean": F.when(key % 17 == 0, "123").when(key % 19 == 0, F.lit(None)).otherwise(F.col("ean")),
        "category": F.when(key % 23 == 0, F.repeat(F.col("category"), F.lit(20))).otherwise(F.col("category")),
    })


def products_validated(spark, d):
    return validate.validate_products(_products(spark, d))[0].select("product_id", "name", "slug", "ean")


def products_rejected(spark, d):
    rows = validate.validate_products(_products(spark, d))[1]
    return rows.select("product_id", F.array_join("broken_rules", ",").alias("broken_rules"))


def alerts_validated(spark, d):
    rows = t.alerts(spark, d).withColumn(
        "target_price",
        F.when(F.col("product_id") % 5 == 0, -F.col("target_price"))
        .when(F.col("product_id") % 7 == 0, F.lit(0)).otherwise(F.col("target_price")),
    )
    return validate.validate_alerts(rows)[0].select("alert_id", "target_price")


def track_requests(spark, d):
    """One request per observed line, with two sibling results and various faults."""
    line, key = F.col("l_linenumber"), F.col("l_partkey")

    def result(store, price, size):
        return F.struct(
            store.alias("store_slug"), price.alias("price"), F.lit("EUR").alias("currency"),
            F.lit("https://shop.example/x").alias("product_url"), size.cast("int").alias("package_size"),
            F.lit(None).cast("double").alias("net_weight"), F.lit(None).cast("string").alias("net_weight_unit"),
            F.lit(None).cast("double").alias("subscribe_price"),
        )

    slug = F.concat(F.lit("supplier-"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0"))
    other = F.concat(F.lit("supplier-"), F.lpad((F.col("l_suppkey") + 1).cast("string"), 9, "0"))
    price = F.col("l_extendedprice")
    siblings = F.array(
        result(other, price + 1, F.col("l_quantity")),
        result(F.lit("nowhere"), price + 2, F.when(line == 3, F.lit(0)).otherwise(F.lit(2))),
    )
    many = F.array_repeat(result(other, price, F.lit(1)), 51)
    return t.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("request_id"),
        (F.col("l_orderkey") % 1000).alias("user_id"), F.concat(F.lit("Artículo nº "), key).alias("name"),
        result(slug, price, F.col("l_quantity")).alias("r"),
        F.when(line == 4, "12").otherwise(F.lpad(key.cast("string"), 13, "0")).alias("ean"),
        F.lit(None).cast("string").alias("image_url"),
        F.when(line == 5, many).when(line != 6, siblings).alias("siblings"),
    ).select("request_id", "user_id", "name", "r.*", "ean", "image_url", "siblings")


def track_requests_validated(spark, d):
    valid, _ = validate.validate_track_requests(track_requests(spark, d))
    return valid.select("request_id", F.size(F.coalesce("siblings", F.array())).alias("n_siblings"))


def track_requests_rejected(spark, d):
    rows = validate.validate_track_requests(track_requests(spark, d))[1]
    return rows.select("request_id", F.array_join("broken_rules", ",").alias("broken_rules"))


QUERIES = {
    f.__name__: f
    for f in [
        offers_validated, offers_rejected, observations_validated, observations_rejected, products_validated,
        products_rejected, alerts_validated, track_requests_validated, track_requests_rejected,
    ]
}

_BAD_OFFERS = """SELECT *, price % 7 < 1 AS bad_url, coalesce(net_weight = 20, false) AS bad_unit,
    coalesce(package_size = 3, false) AS bad_sub FROM offers"""


def _rules(*pairs: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in pairs)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), ',')"


_OBS = """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS observation_id,
    CASE WHEN l_linenumber = 1 THEN l_extendedprice / l_quantity ELSE l_extendedprice END AS price, l_linenumber AS n,
    l_partkey, l_suppkey
  FROM lineitem"""
_OBS_BAD_PRICE = "abs(price * 100 - round(price * 100)) >= 1e-6"
_OBS_BROKEN = _rules(
    ("product_id", "l_partkey % 9 = 0"), ("store_id", "l_suppkey % 10 = 0"), ("price", _OBS_BAD_PRICE), ("currency", "n = 2"), ("url", "n = 6"), ("source", "n = 4"))
_PROD_BROKEN = _rules(
    ("name", "product_id % 11 = 0"), ("slug", "product_id % 13 = 0"),
    ("category", "product_id % 23 = 0 AND length(category) * 20 > 100"), ("ean", "product_id % 17 = 0"))

SQL = {
    "offers_validated": with_ctes(f"""
      SELECT query_id, seq, store_slug, price FROM ({_BAD_OFFERS})
      WHERE price > 0 AND NOT bad_url AND NOT bad_unit AND NOT bad_sub""", "offers"),
    "offers_rejected": with_ctes(f"""
      SELECT query_id, seq, store_slug, broken_rules FROM (SELECT *, {_rules(
        ("price", "price <= 0"), ("subscribe_price", "bad_sub"), ("product_url", "bad_url"),
        ("net_weight_unit", "bad_unit"))} AS broken_rules FROM ({_BAD_OFFERS})) WHERE broken_rules <> ''""", "offers"),
    "observations_validated": f"""
      SELECT observation_id, price, 'EUR' AS currency, CASE WHEN n = 5 THEN 'MANUAL' ELSE 'API' END AS source,
        n % 2 <> 0 AS is_available
      FROM ({_OBS}) WHERE n NOT IN (2, 4, 6) AND l_partkey % 9 <> 0 AND l_suppkey % 10 <> 0 AND NOT ({_OBS_BAD_PRICE})""",
    "observations_rejected": f"""
      SELECT * FROM (SELECT observation_id, {_OBS_BROKEN} AS broken_rules FROM ({_OBS})) WHERE broken_rules <> ''""",
    "products_validated": with_ctes(f"""
      SELECT product_id, name, slug, CASE WHEN product_id % 19 <> 0 THEN ean END AS ean
      FROM products WHERE {_PROD_BROKEN} = ''""", "products"),
    "products_rejected": with_ctes(f"""
      SELECT * FROM (SELECT product_id, {_PROD_BROKEN} AS broken_rules FROM products) WHERE broken_rules <> ''""",
        "products"),
    "alerts_validated": with_ctes("""
      SELECT alert_id, target_price FROM alerts
      WHERE product_id % 5 <> 0 AND product_id % 7 <> 0 AND target_price > 0""", "alerts"),
    "track_requests_validated": """
      SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
        CASE WHEN l_linenumber = 6 THEN 0 ELSE 2 END AS n_siblings
      FROM lineitem WHERE l_linenumber NOT IN (3, 4, 5)""",
    "track_requests_rejected": """
      SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_id,
        CASE WHEN l_linenumber = 4 THEN 'ean' ELSE 'siblings' END AS broken_rules
      FROM lineitem WHERE l_linenumber IN (3, 4, 5)""",
}
