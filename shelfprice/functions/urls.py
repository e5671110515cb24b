"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def absolute_url(href: Column, base: str) -> Column:
    """Prefix a relative link with the shop's address; a missing link gives the address."""
    link = F.coalesce(href, F.lit(""))
    return F.when(link.startswith("http"), link).otherwise(F.concat(F.lit(base), link))


def item_code(href: Column) -> Column:
    """Ten-character item code of a marketplace detail link, null without one."""
    return F.get(F.regexp_extract_all(href, F.lit(r"(?i)/dp/([A-Z0-9]{10})"), 1), F.lit(0))


def item_url(href: Column, base: str) -> Column:
    """Canonical detail URL of a marketplace item."""
    return F.concat(F.lit(base + "/dp/"), item_code(href))


def without_port(url: Column) -> Column:
    """Drop the first explicit TLS port."""
    return F.regexp_replace(url, "^(.*?):443", "$1")


def query_encode(text: Column) -> Column:
    """Percent-encoding with %20 for spaces and the characters !'()*~ kept."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def host(url: Column) -> Column:
    """Host name of an http(s) URL, null when the text is not a URL."""
    shape = r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:@\s]+)"
    return F.lower(F.get(F.regexp_extract_all(url, F.lit(shape), 1), F.lit(0)))


def is_url(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+\S*$"))
