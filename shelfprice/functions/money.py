"""Price text and minor-unit parsing. Missing or unusable input gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, empty when there is none (an empty text casts to a null number)."""
    return F.regexp_extract(text, pattern, group)


def leading_number(text: Column) -> Column:
    """Longest numeric prefix as a double, the rest of the text ignored."""
    prefix = first_match(F.trim(text), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
    return prefix.try_cast("double")


def leading_integer(text: Column) -> Column:
    return first_match(F.trim(text), r"^([+-]?\d+)").try_cast("double")


def spanish_price(text: Column) -> Column:
    """Digits and commas only, the first comma is the decimal point ("12.99" reads as 1299)."""
    kept = F.regexp_replace(text, "[^0-9,]", "")
    return leading_number(F.regexp_replace(kept, "^([0-9]*),", "$1."))


def cents_price(text: Column) -> Column:
    """Up to six digits, a separator and two decimals at the start of the text."""
    pattern = r"^(\d{1,6})[,.](\d{2})"
    whole, cents = first_match(text, pattern, 1), first_match(text, pattern, 2)
    return F.concat(whole, cents).try_cast("double") / F.lit(100.0)


def whole_and_fraction_price(whole: Column, fraction: Column) -> Column:
    """Separate whole and fraction texts; separators in the whole part dropped, fraction "00" if absent."""
    digits = F.trim(F.regexp_replace(whole, "[.,]", ""))
    cents = F.regexp_replace(F.trim(F.coalesce(fraction, F.lit(""))), "^$", "00")
    # The mark keeps a fraction without a whole part from being read as a number.
    joined = first_match(F.concat(digits, F.lit("|"), cents), r"^(\d+\|\d+)")
    return F.replace(joined, F.lit("|")).try_cast("double") / F.lit(100.0)


def comma_decimal_price(text: Column) -> Column:
    """First run of digits and commas, spaces ignored, first comma is the decimal point."""
    run = first_match(F.regexp_replace(text, r"\s", ""), "([0-9,]+)")
    return leading_number(F.regexp_replace(run, "^([0-9]*),", "$1."))


def dotted_thousands_price(text: Column) -> Column:
    """First run of digits, dots and commas; dots are thousands marks, first comma the decimal point."""
    run = first_match(F.regexp_replace(text, r"\s", ""), "([0-9,.]+)")
    return leading_number(F.regexp_replace(F.replace(run, F.lit(".")), "^([0-9]*),", "$1."))


def from_minor_units(amount: Column, digits: Column | int = 2) -> Column:
    """Integer amount in minor units (cents by default) to the major unit."""
    power = F.lit(float(10**digits)) if isinstance(digits, int) else F.pow(F.lit(10.0), digits)
    return amount.cast("double") / power


def round_half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity on the double itself."""
    scale = float(10**digits)
    rounded = F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double")
    return rounded / F.lit(scale) if digits else rounded


def usable_price(price: Column) -> Column:
    """True for a finite price above zero."""
    # Not-a-number sorts above infinity, so the upper bound drops it too.
    return (price > 0) & (price < float("inf"))
