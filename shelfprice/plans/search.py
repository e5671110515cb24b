"""Search over captured offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions.text import plain_spaces
from shelfprice.operators import offers as ops
from shelfprice.operators import resolve
from shelfprice.operators.validate import validate_offers


def askable(queries: DataFrame, least: int = 2) -> DataFrame:
    """Trimmed queries of a useful length (two characters; three for progressive results)."""
    trimmed = queries.withColumn("query", F.trim(plain_spaces(F.col("query"))))
    return trimmed.filter(F.length("query") >= least)


def relevant_offers(queries: DataFrame, offers: DataFrame) -> DataFrame:
    """Valid offers that answer the query they were captured for."""
    valid, _ = validate_offers(offers)
    return ops.keep_relevant(ops.attach_query(valid, queries)).drop("_terms")


def search_offers(queries: DataFrame, offers: DataFrame, least: int = 2) -> DataFrame:
    """Best offer of every store per query, numbered from the cheapest price.

    Take queries of at least `least` characters, validate, match, drop the unwanted variant, reduce to one row per
    store, sort.
    """
    return _best(relevant_offers(askable(queries, least), offers))


def search_with_codes(queries: DataFrame, reference_hits: DataFrame, offers: DataFrame, least: int = 2) -> DataFrame:
    """search_offers, with barcodes first: where a store has offers with a code of the query, these are its answer.

    The codes come from the reference catalogue. Offers of any query with such a code count, and need no matching title.
    """
    asked = askable(queries, least)
    coded = resolve.resolve_eans(asked, reference_hits).select("query_id", "eans")
    valid, _ = validate_offers(offers)
    by_code = resolve.match_by_ean(coded, valid.drop("query_id"))
    by_text = ops.keep_relevant(ops.attach_query(valid, asked)).drop("_terms", "query")
    held = by_code.select("query_id", "store_slug").distinct()
    rest = by_text.join(held, ["query_id", "store_slug"], "left_anti")
    found = by_code.unionByName(rest.select(*by_code.columns))
    return _best(found.join(asked.select("query_id", "query"), "query_id"))


def _best(relevant: DataFrame) -> DataFrame:
    best = ops.best_per_store_by_variant(relevant)
    order = Window.partitionBy("query_id").orderBy(F.col("price").asc(), *ops.arrival(best))
    return best.withColumn("position", F.row_number().over(order))
