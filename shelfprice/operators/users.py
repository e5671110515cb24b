"""Views for users: tracked products, alerts, dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfprice.functions import pricing
from shelfprice.operators.groups import first_per_group
from shelfprice.operators.history import last_n_per_product, latest_per_product_store, newest_first


def best_current_offer(observations: DataFrame, stores: DataFrame) -> DataFrame:
    """Per product: number of stores with a current price and the cheapest of them."""
    latest = latest_per_product_store(observations, available_only=True)
    candidate = F.struct(
        pricing.effective_price().alias("price"), F.col("store_id"), F.col("observation_id")
    )
    best = latest.groupBy("product_id").agg(
        F.count("*").alias("stores"), F.min(candidate).alias("_best")
    )
    named = stores.select("store_id", F.col("name").alias("best_store"))
    return (
        best.select(
            "product_id", "stores", F.col("_best.price").alias("best_price"),
            F.col("_best.store_id").alias("store_id"),
        )
        .join(named, "store_id", "left")
        .drop("store_id")
    )


def tracked_overview(
    tracked: DataFrame, products: DataFrame, observations: DataFrame, stores: DataFrame
) -> DataFrame:
    """Tracked products of every user with the best current offer.

    Offers are reduced to one row per product before the (larger) list of followers is joined.
    """
    offers = products.select("product_id", "name", "slug").join(
        best_current_offer(observations, stores), "product_id", "left"
    )
    return tracked.join(offers, "product_id").withColumn("stores", F.coalesce("stores", F.lit(0)))


def lowest_recent(observations: DataFrame, n: int = 10, shown: int = 3) -> DataFrame:
    """Per product: cheapest of its last n observations and the newest few of them."""
    last = last_n_per_product(observations, n)
    return last.groupBy("product_id").agg(
        F.min(F.struct("price", "recency", "observation_id")).alias("_low"),
        F.slice(F.array_sort(F.collect_list(F.struct("recency", "observation_id", "price"))), 1, shown).alias("recent"),
    ).select(
        "product_id", F.col("_low.price").alias("lowest_price"),
        F.col("_low.observation_id").alias("lowest_observation_id"), "recent",
    )


def tracked_products(
    tracked: DataFrame, products: DataFrame, observations: DataFrame, n: int = 10
) -> DataFrame:
    """Tracked products of every user with their recent prices nested."""
    recent = lowest_recent(observations, n)
    named = products.select("product_id", "name", "slug")
    return tracked.join(named.join(recent, "product_id", "left"), "product_id")


def dashboard_counts(tracked: DataFrame, alerts: DataFrame) -> DataFrame:
    """Tracked products and active alerts per user."""
    follows = tracked.groupBy("user_id").agg(F.count("*").alias("tracked"))
    active = alerts.filter("is_active").groupBy("user_id").agg(F.count("*").alias("active_alerts"))
    return follows.join(active, "user_id", "full").select(
        "user_id", F.coalesce("tracked", F.lit(0)).alias("tracked"),
        F.coalesce("active_alerts", F.lit(0)).alias("active_alerts"),
    )


def recent_for_users(
    tracked: DataFrame, observations: DataFrame, products: DataFrame, stores: DataFrame, n: int = 5
) -> DataFrame:
    """Newest n observations among the tracked products of every user.

    A user's newest n are among the newest n of each product, so the observations are cut down per
    product before the join with the followers.
    """
    recent = last_n_per_product(
        observations.select("observation_id", "product_id", "store_id", "price", "currency", "scraped_at"), n
    ).drop("recency")
    mine = first_per_group(
        tracked.select("user_id", "product_id").join(recent, "product_id"), ["user_id"], newest_first(), n
    )
    return mine.join(
        products.select("product_id", F.col("name").alias("product_name"), F.col("slug").alias("product_slug")),
        "product_id",
    ).join(stores.select("store_id", F.col("name").alias("store_name")), "store_id")


def alerts_view(alerts: DataFrame, products: DataFrame) -> DataFrame:
    """Alerts with their product."""
    return alerts.join(
        products.select("product_id", F.col("name").alias("product_name"), F.col("slug").alias("product_slug")),
        "product_id",
    )


def evaluate_alerts(alerts: DataFrame, observations: DataFrame, moment: str) -> DataFrame:
    """Active alerts not yet fired whose product now costs at most the target."""
    latest = latest_per_product_store(observations, available_only=True)
    current = latest.groupBy("product_id").agg(F.min(pricing.effective_price()).alias("current_price"))
    waiting = alerts.filter(F.col("is_active") & F.col("triggered_at").isNull())
    return (
        waiting.join(current, "product_id")
        .filter(F.col("current_price") <= F.col("target_price").cast("double"))
        .withColumn("triggered_at", F.lit(moment).cast("timestamp_ntz"))
    )
