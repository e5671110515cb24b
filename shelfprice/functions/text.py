"""Text normalisers as native Column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word characters in the ASCII sense; the boundary below does not depend on the JVM's own \b.
WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Every space character that a title may hold besides the plain one.
SPACES = "".join(
    chr(c)
    for c in [*range(9, 14), 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
)


@cache
def _accent_table() -> tuple[str, str]:
    """Accented letters and their bare letters, derived from the Unicode decompositions.

    The combining marks come last and have no partner, so translate() deletes them.
    """
    marks = {chr(c) for c in range(0x300, 0x370)}
    source, target = [], []
    for code in range(0xA0, 0xD800):
        if 0xAC00 <= code <= 0xD7A3 or 0x300 <= code < 0x370:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if c not in marks)
        if len(bare) == 1 and bare != chr(code):
            source.append(chr(code))
            target.append(bare)
    return "".join(source) + "".join(sorted(marks)), "".join(target)


def strip_accents(text: Column) -> Column:
    """Drop diacritics; plain ASCII text skips the lookup."""
    source, target = _accent_table()
    return F.when(_ascii(text), text).otherwise(F.translate(text, source, target))


def _ascii(text: Column) -> Column:
    """As many bytes as characters: no pattern has to read the text."""
    return F.octet_length(text) == F.char_length(text)


def plain_spaces(text: Column) -> Column:
    """Map every space character to the plain space, one for one (positions stay)."""
    # ASCII has five other spaces; text without them stays as it is.
    others = [F.contains(text, F.lit(c)) for c in SPACES if c.isascii()]
    return F.when(_ascii(text) & ~reduce(or_, others), text).otherwise(F.translate(text, SPACES, " " * len(SPACES)))


def fold(text: Column) -> Column:
    """Lower-case and drop diacritics, punctuation kept."""
    return strip_accents(F.lower(text))


def search_text(text: Column) -> Column:
    """Lower-case ASCII letters and digits, every other run becomes one space, trimmed."""
    return search_text_of_folded(fold(text))


def search_text_of_folded(folded: Column) -> Column:
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def loose_text(text: Column) -> Column:
    """Like search_text, but runs of separators keep their length inside the text."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]", " "))


def words(text: Column) -> Column:
    """Words of already normalised text; the empty text has none."""
    return F.filter(F.split(text, " +"), lambda w: w != "")


def pieces_of(text: Column, size: int) -> Column:
    """All runs of `size` characters; a shorter text is its own piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - (size - 1), F.lit(1)))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))


def slugify(text: Column) -> Column:
    """URL slug: accents dropped, lower case, separators to single hyphens, 200 characters at most."""
    dashed = F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, 200)


def title_case(text: Column) -> Column:
    """First character of every word in upper case, the rest untouched."""
    tokens = F.filter(F.split(plain_spaces(text), " +"), lambda w: w != "")
    return F.array_join(
        F.transform(tokens, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))),
        " ",
    )


def truncate(text: Column, length: int) -> Column:
    """At most `length` characters, the last one an ellipsis when something was cut."""
    return F.when(F.length(text) <= length, text).otherwise(
        F.concat(F.substring(text, 1, length - 1), F.lit("…"))
    )


def format_date(moment: Column) -> Column:
    """Long English date, e.g. March 9, 2026."""
    return F.date_format(moment, "MMMM d, yyyy")
