"""Row contracts. Each check splits a DataFrame into valid rows and rejects with rule names."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.functions.urls import is_url
from shelfprice.schemas import PRICE_SOURCES

Rules = dict[str, Column]


def _split(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with the names of the broken rules.

    Valid rows are a plain filter, which stops at the first broken rule and whose parts move below joins; only rejects get a list.
    """
    kept = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    broken = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in kept.items()]))
    checked = df.withColumn("broken_rules", broken)
    return df.filter(reduce(and_, kept.values())), checked.filter(F.size("broken_rules") > 0)


def _filled(name: str) -> Column:
    return F.length(F.col(name)) > 0


def _positive(value: Column) -> Column:
    number = value.cast("double")
    return (number > 0) & ~F.isnan(number) & (number < float("inf"))


def _optional(value: Column, rule: Column) -> Column:
    return value.isNull() | rule


def _cents(value: Column) -> Column:
    """A positive amount with at most two decimals."""
    number = value.cast("double")
    return _positive(value) & (F.abs(number * 100 - F.round(number * 100)) < 1e-6)


def _between(name: str, low: int, high: int) -> Column:
    return F.length(F.col(name)).between(low, high)


def offer_rules() -> Rules:
    size, weight, unit = F.col("package_size"), F.col("net_weight"), F.col("net_weight_unit")
    return {
        "store_slug": _filled("store_slug"),
        "store_name": _filled("store_name"),
        "product_name": _filled("product_name"),
        "price": _positive(F.col("price")),
        "subscribe_price": _optional(F.col("subscribe_price"), _positive(F.col("subscribe_price"))),
        "currency": _filled("currency"),
        "product_url": _filled("product_url"),
        "is_available": F.col("is_available").isNotNull(),
        "package_size": _optional(size, _positive(size) & (size.cast("double") == F.floor(size.cast("double")))),
        "net_weight": _optional(weight, _positive(weight)),
        "net_weight_unit": _optional(unit, unit.isin("g", "ml")),
    }


def validate_offers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df, offer_rules())


def validate_observations(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Defaults first: currency EUR, source MANUAL, available."""
    filled = df.withColumns({
        "currency": F.coalesce("currency", F.lit("EUR")),
        "source": F.coalesce("source", F.lit("MANUAL")),
        "is_available": F.coalesce("is_available", F.lit(True)),
    })
    return _split(filled, {
        "product_id": F.col("product_id").isNotNull(),
        "store_id": F.col("store_id").isNotNull(),
        "price": _cents(F.col("price")),
        "currency": F.length("currency") == 3,
        "url": _optional(F.col("url"), is_url(F.col("url"))),
        "source": F.col("source").isin(*PRICE_SOURCES),
    })


def product_rules(partial: bool = False) -> Rules:
    ean, image = F.col("ean"), F.col("image_url")
    rules = {
        "name": _between("name", 2, 200),
        "slug": _between("slug", 2, 200) & F.regexp_like(F.col("slug"), F.lit("^[A-Za-z0-9_-]+$")),
    }
    if partial:
        rules = {name: _optional(F.col(name), rule) for name, rule in rules.items()}
    return rules | {
        "description": _optional(F.col("description"), F.length("description") <= 2000),
        "image_url": _optional(image, is_url(image)),
        "category": _optional(F.col("category"), F.length("category") <= 100),
        "brand": _optional(F.col("brand"), F.length("brand") <= 100),
        "ean": _optional(ean, F.regexp_like(ean, F.lit(r"^\d{8,13}$"))),
    }


def validate_products(df: DataFrame, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    """With partial, absent fields are fine (an update names only what it changes)."""
    return _split(df, product_rules(partial))


def validate_alerts(df: DataFrame, partial: bool = False) -> tuple[DataFrame, DataFrame]:
    target = F.col("target_price")
    rule = _cents(target)
    rules = {"target_price": _optional(target, rule) if partial else rule}
    if not partial:
        rules["product_id"] = F.col("product_id").isNotNull()
    return _split(df, rules)


def _result_rules(row: Column) -> Column:
    """Shared checks of the chosen result and of each of its siblings."""
    unit, size = row["net_weight_unit"], row["package_size"]
    checks = [
        F.length(row["store_slug"]).between(1, 100),
        _positive(row["price"]),
        _optional(row["currency"], F.length(row["currency"]) == 3),
        _optional(row["product_url"], is_url(row["product_url"])),
        _optional(size, _positive(size)),
        _optional(row["net_weight"], _positive(row["net_weight"])),
        _optional(unit, unit.isin("g", "ml")),
        _optional(row["subscribe_price"], _positive(row["subscribe_price"])),
    ]
    out = F.lit(True)
    for check in checks:
        out = out & F.coalesce(check, F.lit(False))
    return out


def validate_track_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chosen search result with up to 50 sibling results of other stores."""
    names = [
        "store_slug", "price", "currency", "product_url", "package_size", "net_weight",
        "net_weight_unit", "subscribe_price",
    ]
    siblings = F.coalesce(F.col("siblings"), F.array())
    ean, image = F.col("ean"), F.col("image_url")
    return _split(df, {
        "name": _between("name", 2, 200),
        "result": _result_rules(F.struct(*names)),
        "image_url": _optional(image, is_url(image)),
        "ean": _optional(ean, F.regexp_like(ean, F.lit(r"^\d{8,13}$"))),
        "siblings": F.col("siblings").isNull()
        | ((F.size(siblings) <= 50) & F.forall(F.col("siblings"), _result_rules)),
    })
