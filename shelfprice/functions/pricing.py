"""Comparable prices: effective price, comparison mode, price per kilogram, litre or unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comparison modes in the order that breaks ties, and their display units.
MODES = ["per100g", "per100ml", "perUnit", "rawPrice"]
MODE_HEADERS = {"per100g": "€/kg", "per100ml": "€/l", "perUnit": "€/ud", "rawPrice": "€/pack"}
MODE_UNITS = {"per100g": "kg", "per100ml": "l", "perUnit": "ud", "rawPrice": "pack"}


VOTES = ["votes_g", "votes_ml", "votes_unit"]


def _double(name: str) -> Column:
    return F.col(name).cast("double")


def effective_price(shipping: bool = False) -> Column:
    """Subscription price when there is one, else the price; optionally plus known shipping."""
    base = F.coalesce(_double("subscribe_price"), _double("price"))
    return base + F.coalesce(_double("shipping_cost"), F.lit(0.0)) if shipping else base


def pack_unit_price() -> Column:
    """Effective price per item of the pack, a pack of unknown size counting as one item."""
    return F.try_divide(effective_price(), F.coalesce(_double("package_size"), F.lit(1.0)))


def mode_votes() -> dict[str, Column]:
    """Three counters (weight, volume, counted items) to be summed per group."""
    unit = F.col("net_weight_unit")
    unlabelled = ~F.coalesce(unit.isin("g", "ml"), F.lit(False))
    return {
        "votes_g": F.count(F.when(unit == "g", True)),
        "votes_ml": F.count(F.when(unit == "ml", True)),
        "votes_unit": F.count(F.when(unlabelled, F.col("package_size"))),
    }


def winning_mode() -> Column:
    """Majority of the vote columns; ties go to weight, then volume, then counted items."""
    votes_g, votes_ml, votes_unit = F.col("votes_g"), F.col("votes_ml"), F.col("votes_unit")
    top = F.greatest(votes_g, votes_ml, votes_unit)
    return (
        F.when(top == 0, F.lit("rawPrice"))
        .when(votes_g == top, F.lit("per100g"))
        .when(votes_ml == top, F.lit("per100ml"))
        .otherwise(F.lit("perUnit"))
    )


def comparable_price(mode: Column, shipping: bool = False) -> Column:
    """Price normalised for the mode; null when the row lacks what the mode needs.

    The weight modes use the net weight whatever its own unit label says.
    """
    base = effective_price(shipping)
    weight = _double("net_weight")
    total = F.coalesce(_double("package_size"), F.lit(1.0)) * weight
    by_weight = F.when(weight > 0, F.try_divide(base, total) * F.lit(1000.0))
    return (
        F.when(mode.isin("per100g", "per100ml"), by_weight)
        .when(mode == "perUnit", F.try_divide(base, _double("package_size")))
        .when(mode == "rawPrice", base)
    )


def unit_price_order(comparable: str, effective: str, *ties: str) -> list[Column]:
    """Sort keys: computable prices ascending, the others last by effective price, then the ties."""
    price = F.col(comparable)
    return [
        price.asc_nulls_last(),
        F.when(price.isNull(), F.col(effective)).asc_nulls_last(),
        *[F.col(c).asc() for c in ties],
    ]


def _lookup(mode: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in table.items():
        out = out.when(mode == key, F.lit(value))
    return out


def mode_header(mode: Column) -> Column:
    return _lookup(mode, MODE_HEADERS)


def mode_unit(mode: Column) -> Column:
    return _lookup(mode, MODE_UNITS)
