"""Price observations over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions import labels, pricing
from shelfprice.operators.groups import first_per_group
from shelfprice.operators.offers import with_mode_of_small_group

def newest_first() -> list[Column]:
    return [F.col("scraped_at").desc(), F.col("observation_id").desc()]


def latest_per_product_store(observations: DataFrame, available_only: bool = False) -> DataFrame:
    """Newest observation of each product in each store.

    With available_only, unavailable rows are dropped first, so an older available row can win.
    """
    rows = observations.filter("is_available") if available_only else observations
    return first_per_group(rows, ["product_id", "store_id"], newest_first())


def latest_with_url(observations: DataFrame, products: DataFrame) -> DataFrame:
    """Newest observation with a URL per store and active product (input of a re-scrape)."""
    latest = latest_per_product_store(observations.filter(F.col("url").isNotNull()))
    return latest.join(products.filter("is_active").select("product_id"), "product_id", "left_semi")


def last_n_per_product(observations: DataFrame, n: int) -> DataFrame:
    """Newest n observations of every product, numbered."""
    window = Window.partitionBy("product_id").orderBy(*newest_first())
    return observations.withColumn("recency", F.row_number().over(window)).filter(F.col("recency") <= n)


def history(
    observations: DataFrame, product_id: int | None = None, store_id: int | None = None,
    start: str | None = None, end: str | None = None, limit: int = 90,
) -> DataFrame:
    """Newest observations in an inclusive time range, up to `limit` (at most 365) per product."""
    if not 1 <= limit <= 365:
        raise ValueError("limit must be between 1 and 365")
    rows = observations
    if product_id is not None:
        rows = rows.filter(F.col("product_id") == product_id)
    if store_id is not None:
        rows = rows.filter(F.col("store_id") == store_id)
    # Tables stored by day carry the day as a column; a bound on it skips whole folders.
    by_day = "scrape_date" in rows.columns
    if start is not None:
        low = F.lit(start).cast("timestamp_ntz")
        rows = rows.filter(F.col("scraped_at") >= low)
        rows = rows.filter(F.col("scrape_date") >= low.cast("date")) if by_day else rows
    if end is not None:
        high = F.lit(end).cast("timestamp_ntz")
        rows = rows.filter(F.col("scraped_at") <= high)
        rows = rows.filter(F.col("scrape_date") <= high.cast("date")) if by_day else rows
    return last_n_per_product(rows, limit)


def price_ranking(observations: DataFrame, stores: DataFrame, products: DataFrame) -> DataFrame:
    """Stores of every active product ranked by comparable price including shipping.

    The newest available observation per store is taken first, so each product has at most one row
    per store when its mode, lowest price and positions are computed in one shuffle by product.
    """
    latest = latest_per_product_store(
        observations.select(
            "observation_id", "product_id", "store_id", "price", "subscribe_price", "package_size",
            "net_weight", "net_weight_unit", "shipping_cost", "url", "scraped_at", "is_available",
        ),
        available_only=True,
    )
    store = stores.select(
        "store_id", F.col("name").alias("store_name"), F.col("website_url").alias("store_url"),
        "free_shipping_threshold", "shipping_note",
    )
    product = products.filter("is_active").select(
        "product_id", F.col("slug").alias("product_slug"), "category"
    )
    rows = latest.join(store, "store_id").join(product, "product_id")

    whole = Window.partitionBy("product_id")
    priced = with_mode_of_small_group(rows, ["product_id"]).withColumns({
        "effective_price": pricing.effective_price(shipping=True),
        "unit_price": pricing.comparable_price(F.col("mode"), shipping=True),
        "_plain_unit_price": pricing.comparable_price(F.col("mode"), shipping=False),
    })
    order = whole.orderBy(*pricing.unit_price_order("unit_price", "effective_price", "store_id"))
    return priced.withColumns({
        "position": F.row_number().over(order),
        "lowest_unit_price": F.min("_plain_unit_price").over(whole),
    }).withColumns({
        "is_best": F.col("position") == 1,
        "quantity_label": labels.quantity_label(
            F.col("package_size"), F.col("net_weight"), F.col("net_weight_unit")
        ),
        "shipping_label": labels.shipping_label(
            F.col("shipping_cost"), F.col("free_shipping_threshold"), F.col("shipping_note")
        ),
        "mode_header": pricing.mode_header(F.col("mode")),
        "header_suffix": labels.header_suffix(F.col("mode"), labels.unit_label(F.col("category"))),
        "unit_price_label": F.coalesce(
            labels.comparable_text(F.col("unit_price"), F.col("mode")), F.lit(labels.DASH)
        ),
    }).drop("_plain_unit_price")


def product_summary(observations: DataFrame) -> DataFrame:
    """Per product: stores with a current price, lowest price and lowest price per pack item."""
    latest = latest_per_product_store(observations, available_only=True)
    per_item = F.try_divide(F.col("price").cast("double"), F.col("package_size").cast("double"))
    return latest.groupBy("product_id").agg(
        F.count("*").alias("stores"),
        F.min("price").alias("lowest_price"),
        F.min(per_item).alias("lowest_unit_price"),
    )


def price_trend(observations: DataFrame) -> DataFrame:
    """Lowest price per product, store and day, with the change since the previous observed day."""
    daily = observations.groupBy(
        "product_id", "store_id", F.to_date("scraped_at").alias("day")
    ).agg(F.min("price").alias("price"))
    window = Window.partitionBy("product_id", "store_id").orderBy("day")
    previous = F.lag("price").over(window)
    return daily.withColumns({"previous_price": previous, "change": F.col("price") - previous})
