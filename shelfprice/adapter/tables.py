"""Model tables derived from the star-schema parquet files by projection.

oracle.py states the same derivations in SQL; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.functions.text import slugify


#: Bytes of a generated method above which the JVM never compiles it; Spark's own limit is far above that.
METHOD_BYTES = "8000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. A session that has no limit of its own for generated methods gets the JVM's, so that long row rules are compiled."""
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535":
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", METHOD_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(value: Column) -> Column:
    """Cents, half up, as the stored decimal."""
    return (F.floor(value * 100.0 + 0.5) / F.lit(100.0)).cast("decimal(10,2)")


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_nationkey")
    slug = slugify(F.col("s_name"))
    kind = F.when(key % 3 == 0, "ONLINE").when(key % 3 == 1, "PHYSICAL").otherwise("BOTH")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("name"), slug.alias("slug"),
        kind.alias("type"), F.concat(F.lit("https://"), slug, F.lit(".example")).alias("website_url"),
        _null().alias("logo_url"), (F.col("s_acctbal") >= 0).alias("is_active"),
        F.when(key % 4 != 0, (F.lit(10) * (key % 6 + 1)).cast("decimal(10,2)")).alias("free_shipping_threshold"),
        F.when(key % 5 != 0, F.lit("Envío 24/48 h")).alias("shipping_note"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.concat_ws(" ", "p_brand", "p_name")
    return table(spark, sf_dir, "part").select(
        key.alias("product_id"), name.alias("name"),
        slugify(F.concat_ws(" ", name, key.cast("string"))).alias("slug"),
        _null().alias("description"), _null().alias("image_url"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"), F.lpad(key.cast("string"), 13, "0").alias("ean"),
        (F.col("p_size") != 50).alias("is_active"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, line = F.col("l_partkey"), F.col("l_linenumber")
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0 + 0.5) / F.lit(100.0)
    weighed = part % 3 != 2
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"),
        part.alias("product_id"), F.col("l_suppkey").alias("store_id"),
        price.cast("decimal(10,2)").alias("price"), F.lit("EUR").alias("currency"),
        F.when(line != 7, F.concat_ws("/", F.lit("https://shop.example"), "l_suppkey", "l_partkey")).alias("url"),
        F.when(line % 4 == 0, "MANUAL").when(line % 4 == 1, "API").otherwise("SCRAPE").alias("source"),
        (F.col("l_returnflag") != "R").alias("is_available"),
        F.when(line % 5 != 0, F.col("l_quantity").cast("int")).alias("package_size"),
        F.when(weighed, ((part % 50 + 1) * 10).cast("decimal(10,2)")).alias("net_weight"),
        F.when(part % 3 == 0, "g").when(part % 3 == 1, "ml").alias("net_weight_unit"),
        F.when(F.col("l_discount") > 0.05, _money(price * (1 - F.col("l_discount")))).alias("subscribe_price"),
        F.when(F.col("l_tax") <= 0.06, _money(F.col("l_tax") * 100.0)).alias("shipping_cost"),
        F.col("l_shipdate").alias("scraped_at"),
    )


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"))
        .agg(F.min("o_orderdate").alias("created_at"))
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.col("user_id") + F.col("product_id")
    return tracked(spark, sf_dir).select(
        F.concat_ws("-", "user_id", "product_id").alias("alert_id"), "user_id", "product_id",
        (F.lit(500) + (F.col("user_id") * 31 + F.col("product_id")) % 3000)
        .cast("decimal(10,2)").alias("target_price"),
        (both % 5 != 0).alias("is_active"), _null("timestamp_ntz").alias("triggered_at"), "created_at",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("store_id"),
        F.col("o_orderdate").alias("started_at"),
        F.when(state != "P", F.col("o_orderdate")).alias("finished_at"),
        F.when(state == "F", "SUCCESS").when(state == "O", "FAILED").otherwise("RUNNING").alias("status"),
        (F.col("o_orderkey") % 50).cast("int").alias("products_scraped"),
        F.when(state == "O", F.lit("HTTP 503")).alias("error_message"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every product asked for by its name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("query_id"), F.concat_ws(" ", "p_brand", "p_name").alias("query")
    )


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offers captured for those queries: every observed line under one of seven titles."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name")
    line = F.col("l_linenumber")
    full = F.concat_ws(" ", "p_brand", "p_name")
    title = (
        F.when(line == 1, F.concat(full, F.lit(" 6x33cl")))
        .when(line == 2, F.concat(full, F.lit(" con gas 1,5 L")))
        .when(line == 3, F.concat(F.upper(full), F.lit(" sin gas")))
        .when(line == 4, F.col("p_name"))
        .when(line == 5, F.concat(F.lit("Pack "), full))
        .when(line == 6, F.concat(F.col("p_brand"), F.lit(" surtido")))
        .otherwise(F.concat(full, F.lit(" sparkling")))
    )
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0 + 0.5) / F.lit(100.0)
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_partkey").alias("query_id"),
        # Arrival order within a query.
        F.concat_ws("-", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), "l_linenumber", F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("seq"),
        F.concat(F.lit("supplier-"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("store_slug"),
        F.concat(F.lit("Supplier "), F.col("l_suppkey")).alias("store_name"), title.alias("product_name"),
        F.when(F.col("l_quantity") == 50, F.lit(0.0)).otherwise(price).alias("price"),
        F.when(F.col("l_discount") > 0.05, F.floor(price * (1 - F.col("l_discount")) * 100.0 + 0.5) / F.lit(100.0)).alias("subscribe_price"),
        F.lit("EUR").alias("currency"), _null().alias("image_url"),
        F.concat_ws("/", F.lit("https://shop.example"), "l_suppkey", "l_partkey").alias("product_url"),
        (F.col("l_returnflag") != "R").alias("is_available"),
        F.when(line % 5 != 0, F.col("l_quantity").cast("int")).alias("package_size"),
        F.when(line % 2 == 0, (F.col("l_partkey") % 50 + 1) * 10.0).alias("net_weight"),
        F.when(line % 2 == 0, F.when(F.col("l_partkey") % 3 == 0, "g").otherwise("ml")).alias("net_weight_unit"),
        F.when((line == 6) & (F.col("l_returnflag") == "N"), F.lpad(F.col("l_partkey").cast("string"), 13, "0")).alias("ean"),
    )
