"""Does a product title answer a query? Token rules over normalised text."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfprice.functions.money import let
from shelfprice.functions.text import WORD, fold, plain_spaces, search_text, search_text_of_folded, strip_accents

# Words that carry no meaning in a query.
STOP_WORDS = [
    "de", "la", "el", "en", "y", "a", "los", "las", "del", "con", "por", "un", "una", "es", "al", "se",
    "que", "para", "pack", "uds", "unidades", "panales", "talla",
]
# Words that name a variant and therefore must be in the title.
DISCRIMINATORS = [
    "pure", "sensitive", "activity", "harmonie", "desnatado", "semidesnatado", "entero", "integral",
    "natural", "fresa", "frambuesa", "limon", "naranja", "mango", "tropical", "vainilla", "chocolate",
    "platano", "melocoton", "pistacho", "cacao", "original", "clasico",
]
# Phrases for sparkling and for still products.
SPARKLING = ["con gas", "carbonatada", "carbonatado", "con burbujas", "sparkling"]
STILL = ["sin gas", "still"]
# Share of the query words a title must hold.
THRESHOLD = 0.8


def _is_number(token: Column) -> Column:
    return F.regexp_like(token, F.lit("^[0-9]+$"))


def query_terms(query: Column) -> Column:
    """What a query asks for: struct<words, must, numbers, sized>.

    `must` are the words no title may lack; `sized` says that the query names a garment size, so
    that its numbers must be sizes in the title.
    """
    def read(text: Column) -> Column:
        tokens = F.split(text, " ")
        words = F.filter(
            tokens, lambda t: ~_is_number(t) & (F.length(t) >= 2) & ~t.isin(*STOP_WORDS)
        )
        return F.struct(
            words.alias("words"),
            F.filter(words, lambda w: w.isin(*DISCRIMINATORS)).alias("must"),
            F.array_distinct(F.filter(tokens, _is_number)).alias("numbers"),
            F.regexp_like(text, F.lit(rf"(?<!{WORD})talla\s*[0-9]")).alias("sized"),
        )

    return let(search_text(query), read)


def title_numbers(folded: Column, sized: Column) -> Column:
    """Numbers of a folded title that may answer a query number.

    For a sized query these are garment sizes ("talla 5", "t5"); otherwise whole numbers with neither
    a digit nor a hyphen next to them, which leaves out the ends of ranges.
    """
    end = f"(?!{WORD})"
    sizes = F.concat(
        F.regexp_extract_all(folded, F.lit(rf"talla\s*([0-9]+){end}"), 1),
        F.regexp_extract_all(folded, F.lit(rf"(?<!{WORD})t([0-9]+){end}"), 1),
    )
    # The look ahead turns down most places before the look behind has to.
    alone = F.regexp_extract_all(folded, F.lit("(?=[0-9])(?<![0-9-])([0-9]++)(?![0-9-])"), 1)
    return F.when(sized, sizes).otherwise(alone)


def terms_match(terms: Column, name: Column, folded: Column) -> Column:
    """Rule over prepared parts: query terms, normalised title and folded (punctuation kept) title."""
    words, numbers = terms["words"], terms["numbers"]
    hits = F.size(F.filter(words, lambda w: F.contains(name, w)))
    enough = (F.size(words) == 0) | (
        F.try_divide(hits.cast("double"), F.size(words).cast("double")) >= THRESHOLD
    )
    variants = F.forall(terms["must"], lambda w: F.contains(name, w))
    numbers_found = (F.size(numbers) == 0) | (
        F.size(F.array_except(numbers, title_numbers(folded, terms["sized"]))) == 0
    )
    return enough & variants & numbers_found


def title_matches(terms: Column, name: Column) -> Column:
    """Does a raw title answer the terms of a query?"""
    # Step by step what fold() does: each form of the title is used several times.
    return let(F.lower(plain_spaces(name)), lambda lowered: let(
        strip_accents(lowered),
        lambda folded: let(search_text_of_folded(folded), lambda normal: terms_match(terms, normal, folded)),
    ))


def is_relevant(name: Column, query: Column) -> Column:
    """True when the title answers the query (a query without usable words matches everything)."""
    return let(query_terms(query), lambda terms: title_matches(terms, name))


def _has_any(text: Column, phrases: list[str]) -> Column:
    folded = fold(text)
    return reduce(or_, [F.contains(folded, F.lit(p)) for p in phrases])


def has_sparkling(text: Column) -> Column:
    return _has_any(text, SPARKLING)


def has_still(text: Column) -> Column:
    return _has_any(text, STILL)


def variant_conflict(name: Column, query: Column) -> Column:
    """True when the title is the variant the query does not want; without a wish sparkling is unwanted."""
    return F.when(has_sparkling(query), has_still(name)).otherwise(has_sparkling(name))
