"""Product catalogue: filtering, pages, counts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.functions.labels import store_type_rank


def catalog_filter(
    products: DataFrame, category: str | None = None, brand: str | None = None, q: str | None = None
) -> DataFrame:
    """Active products by category, brand and a case-insensitive part of the name."""
    rows = products.filter("is_active")
    if category:
        rows = rows.filter(F.col("category") == category)
    if brand:
        rows = rows.filter(F.col("brand") == brand)
    if q:
        rows = rows.filter(F.contains(F.lower("name"), F.lower(F.lit(q))))
    return rows


def paginate(df: DataFrame, order: list[Column], page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a sorted DataFrame (at most 100 rows)."""
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page must be positive and page_size between 1 and 100")
    return df.orderBy(*order).offset((page - 1) * page_size).limit(page_size)


def page_after(df: DataFrame, keys: list[str], after: tuple | None = None, page_size: int = 20) -> DataFrame:
    """The page that follows a row with the given key values, in the order of the keys; None: the first page.

    Unlike a page number it skips nothing, so the millionth page costs as much as the first. No key may be null.
    """
    if not 1 <= page_size <= 100:
        raise ValueError("page_size must be between 1 and 100")
    if after is not None:
        df = df.filter(F.struct(*keys) > F.struct(*[F.lit(v).cast(df.schema[k].dataType).alias(k) for k, v in zip(keys, after, strict=True)]))
    return df.orderBy(*keys).limit(page_size)


def page_meta(df: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One row that describes the page."""
    total = F.col("total")
    pages = F.ceil(total / F.lit(float(page_size)))
    return df.agg(F.count("*").alias("total")).select(
        F.lit(page).alias("page"), F.lit(page_size).alias("page_size"), total,
        pages.alias("total_pages"), (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )


def catalog_counts(products: DataFrame, observations: DataFrame, tracked: DataFrame) -> DataFrame:
    """Numbers of observations and of followers for each product."""
    seen = observations.groupBy("product_id").agg(F.count("*").alias("observations"))
    followed = tracked.groupBy("product_id").agg(F.count("*").alias("trackers"))
    joined = products.join(seen, "product_id", "left").join(followed, "product_id", "left")
    return joined.withColumns({
        "observations": F.coalesce("observations", F.lit(0)),
        "trackers": F.coalesce("trackers", F.lit(0)),
    })


def catalog_page(
    products: DataFrame, observations: DataFrame, tracked: DataFrame, *,
    category: str | None = None, brand: str | None = None, q: str | None = None,
    page: int = 1, page_size: int = 20,
) -> DataFrame:
    """One page of the catalogue by name. Counts are made for the products of the page only."""
    found = catalog_filter(products, category, brand, q)
    shown = paginate(found, [F.col("name"), F.col("product_id")], page, page_size)
    # A page has at most 100 rows, so its keys can be sent to every task.
    keys = F.broadcast(shown.select("product_id"))
    return catalog_counts(
        shown,
        observations.join(keys, "product_id", "left_semi"),
        tracked.join(keys, "product_id", "left_semi"),
    ).orderBy("name", "product_id")


def by_id_or_slug(products: DataFrame, keys: DataFrame) -> DataFrame:
    """Products named by identifier or by slug (column `key`); two equal-joins instead of an OR-join."""
    text_id = products.withColumn("key", F.col("product_id").cast("string")).join(keys, "key")
    by_slug = products.withColumn("key", F.col("slug")).join(keys, "key")
    return text_id.unionByName(by_slug).dropDuplicates(["key", "product_id"])


def with_size_metadata(products: DataFrame, metadata: DataFrame) -> DataFrame:
    """Products with the size and weight range kept for some slugs."""
    return products.join(metadata.select("slug", "size", "weight_range"), "slug", "left")


def listing_order_stores(stores: DataFrame) -> DataFrame:
    """Stores by type in enum order, then by name."""
    return stores.orderBy(store_type_rank(F.col("type")), "name")
