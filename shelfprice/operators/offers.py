"""Offers of a search: relevance, variant conflicts, best per store, ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions import pricing
from shelfprice.functions.relevance import query_terms, title_matches, variant_conflict
from shelfprice.operators.groups import first_per_group


def attach_query(offers: DataFrame, queries: DataFrame) -> DataFrame:
    """Join offers with the query they were captured for; the query is taken apart once per query."""
    prepared = queries.select("query_id", "query", query_terms(F.col("query")).alias("_terms"))
    return offers.join(prepared, "query_id")


def keep_relevant(offers: DataFrame) -> DataFrame:
    """Barcode matches stay; other offers must answer their query (input of attach_query)."""
    relevant = title_matches(F.col("_terms"), F.col("product_name"))
    return offers.filter(F.col("ean").isNotNull() | relevant)


def filter_variant_conflicts(offers: DataFrame, group: Sequence[str] = ("query_id",)) -> DataFrame:
    """Drop offers of the unwanted variant, unless that would leave the group empty.

    The groups without a clean offer, a short list, are all that the offers are joined with.
    """
    conflict = variant_conflict(F.col("product_name"), F.col("query"))
    flagged = offers.withColumn("_conflict", F.coalesce(conflict, F.lit(False)))
    all_bad = flagged.groupBy(*group).agg(F.min("_conflict").alias("_all_bad")).filter("_all_bad")
    judged = flagged.join(all_bad, list(group), "left")
    kept = judged.filter(~F.col("_conflict") | F.col("_all_bad"))
    return kept.select(*offers.columns)


def best_per_store(
    offers: DataFrame, keys: Sequence[str] = ("query_id", "store_slug"), by: str = "unit"
) -> DataFrame:
    """Cheapest offer per query and store, by price per pack item or by plain price; earliest wins ties."""
    value = pricing.pack_unit_price() if by == "unit" else F.col("price").cast("double")
    return first_per_group(offers, keys, [value.asc_nulls_last(), *arrival(offers)])


def arrival(offers: DataFrame) -> list[Column]:
    """Total order of arrival: place in its shop's list, then the capture it came from.

    A query captured twice for a shop has each place twice, so the older capture, by time and number, comes first. Columns
    that the offers don't have don't count; the content of a row settles what is still equal.
    """
    first = [c for c in ("seq", "fetched_at", "capture_id") if c in offers.columns]
    content = [c for c in ("price", "product_name", "product_url", "subscribe_price") if c in offers.columns]
    return [F.col(c).asc_nulls_last() for c in first + content]


def best_per_store_by_variant(offers: DataFrame) -> DataFrame:
    """Variant filter over the whole query plus best per store, with one reduction.

    Each store keeps its best conflict-free offer, or its best offer where all are in conflict. Whether
    the latter count depends on the whole query, which by then has one row per store.
    """
    conflict = variant_conflict(F.col("product_name"), F.col("query"))
    flagged = offers.withColumns({
        "_conflict": F.coalesce(conflict, F.lit(False)), "_unit": pricing.pack_unit_price(),
    })
    best = first_per_group(
        flagged, ["query_id", "store_slug"], [F.col("_conflict").asc(), F.col("_unit").asc_nulls_last(), *arrival(offers)]
    )
    has_clean = F.max(~F.col("_conflict")).over(Window.partitionBy("query_id"))
    judged = best.withColumn("_has_clean", has_clean).filter(~F.col("_conflict") | ~F.col("_has_clean"))
    return judged.drop("_conflict", "_unit", "_has_clean")


def comparison_mode(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group with its comparison mode."""
    votes = df.groupBy(*group).agg(*[v.alias(name) for name, v in pricing.mode_votes().items()])
    return votes.withColumn("mode", pricing.winning_mode())


def lowest_unit_price(df: DataFrame, group: Sequence[str], shipping: bool) -> DataFrame:
    """Lowest comparable price per group; null when no row has the data.

    One aggregation: the votes and the lowest price under each mode side by side, then the winner's.
    """
    lowest = {m: F.min(pricing.comparable_price(F.lit(m), shipping)) for m in pricing.MODES}
    votes = df.groupBy(*group).agg(
        *[v.alias(name) for name, v in pricing.mode_votes().items()], *[v.alias(f"_low_{m}") for m, v in lowest.items()],
    )
    chosen = F.coalesce(*[F.when(F.col("mode") == m, F.col(f"_low_{m}")) for m in pricing.MODES])
    return votes.withColumn("mode", pricing.winning_mode()).select(*group, "mode", chosen.alias("lowest_unit_price"))


def with_mode_of_small_group(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The same for groups that are small by construction, within the shuffle their ranking needs."""
    window = Window.partitionBy(*group)
    voted = df.withColumns({name: v.over(window) for name, v in pricing.mode_votes().items()})
    return voted.withColumn("mode", pricing.winning_mode()).drop(*pricing.VOTES)


def rank_offers(
    offers: DataFrame, group: Sequence[str] = ("query_id",), sort: str = "unit",
    ties: Sequence[str] = ("seq",),
) -> DataFrame:
    """Position, comparable price (with shipping) and best flags of every offer in its group.

    Meant for reduced results (one row per store), so that a group is as small as the store list.
    """
    whole = Window.partitionBy(*group)
    priced = with_mode_of_small_group(offers, group).withColumns({
        "effective_price": pricing.effective_price(shipping=True),
        "unit_price": pricing.comparable_price(F.col("mode"), shipping=True),
    })
    tie_columns = [F.col(c).asc() for c in ties]
    if sort == "unit":
        order = pricing.unit_price_order("unit_price", "effective_price", *ties)
    elif sort == "total":
        order = [F.col("effective_price").asc_nulls_last(), *tie_columns]
    else:
        order = [F.col("price").cast("double").asc_nulls_last(), *tie_columns]
    lowest = F.min("unit_price").over(whole)
    cheapest = F.min("price").over(whole)
    return priced.withColumns({
        "position": F.row_number().over(whole.orderBy(*order)),
        "is_best_unit": F.coalesce(F.abs(F.col("unit_price") - lowest) < 0.0001, F.lit(False)),
        "is_best_price": F.coalesce(lowest.isNull() & (F.col("price") == cheapest), F.lit(False)),
    })


def stores_found(offers: DataFrame) -> DataFrame:
    """Number of results and of stores per query.

    Grouping by query and store first leaves one row per store, so no group of distinct values is
    held in memory.
    """
    per_store = offers.groupBy("query_id", "store_slug").agg(F.count("*").alias("_n"))
    return per_store.groupBy("query_id").agg(
        F.sum("_n").alias("results"), F.count("*").alias("stores_found")
    )
