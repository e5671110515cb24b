"""Lookups that precede a search: barcodes, categories, fallbacks, relaxed queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.functions.text import loose_text, pieces_of, search_text, strip_accents, words
from shelfprice.operators.groups import first_per_group


#: Items of one word that a task takes before the word is dealt to several.
CROWDED = 20_000


def resolve_eans(
    queries: DataFrame, reference_hits: DataFrame, rows: int = 10, eans: int = 5
) -> DataFrame:
    """Barcodes and canonical name of each query from the most scanned catalogue hits.

    Of the first rows, codes of 8 to 14 digits count; the name is the best hit's Spanish name, else
    its name, else the query.
    """
    order = [F.col("scans").desc(), F.col("hit_id").asc()]
    window = Window.partitionBy("query_id").orderBy(*order)
    top = reference_hits.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= rows)
    code = F.when(F.regexp_like(F.col("code"), F.lit(r"^\d{8,14}$")), F.struct("_rank", "code"))
    found = top.groupBy("query_id").agg(
        F.slice(F.transform(F.array_sort(F.collect_list(code)), lambda s: s["code"]), 1, eans).alias("eans"),
        F.min(F.struct("_rank", "name_es", "name")).alias("_best"),
    )

    def filled(name: str):
        return F.nullif(F.col(name), F.lit(""))

    return queries.join(found, "query_id", "left").select(
        "query_id", "query", F.coalesce("eans", F.array().cast("array<string>")).alias("eans"),
        F.coalesce(filled("_best.name_es"), filled("_best.name"), F.col("query")).alias("canonical_name"),
    )


def query_keywords(queries: DataFrame, least: int) -> DataFrame:
    """One row per query and distinct keyword of at least `least` characters."""
    keywords = F.filter(words(loose_text(F.col("query"))), lambda w: F.length(w) >= least)
    return queries.select("query_id", F.explode(F.array_distinct(keywords)).alias("keyword"))


def flat_categories(tree: DataFrame) -> DataFrame:
    """Top and sub categories of a nested tree in reading order: position, id and name."""
    node = F.struct(F.col("id"), F.col("name"))
    nodes = F.concat(
        F.array(node),
        F.transform(
            F.coalesce(F.col("categories"), F.array()),
            lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name")),
        ),
    )
    exploded = tree.select("position", F.posexplode(nodes).alias("_sub", "_node"))
    return exploded.select(
        F.struct(F.col("position"), F.col("_sub")).alias("position"),
        F.trim(F.col("_node.id")).alias("category_id"), F.col("_node.name").alias("category_name"),
    )


def _keyword_hits(keywords: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """Pairs of a distinct keyword and a row whose text holds it.

    Keywords meet rows through a shared piece of up to three letters instead of a cross join; the final containment test is exact.
    """
    size = F.least(F.length("keyword"), F.lit(3))
    wanted = keywords.select("keyword").distinct().withColumn("_piece", F.substr("keyword", F.lit(1), size))
    normal = loose_text(F.col(text))
    pieces = F.array_distinct(F.concat(pieces_of(normal, 2), pieces_of(normal, 3)))
    exploded = rows.withColumn("_text", normal).withColumn("_piece", F.explode_outer(pieces))
    return exploded.join(wanted, "_piece").filter(F.contains("_text", "keyword")).drop("_piece", "_text")


def match_categories(tree: DataFrame, queries: DataFrame, n: int = 3) -> DataFrame:
    """First n distinct categories whose name holds a keyword (three letters or more) of the query.

    A category among a query's first n is among the first n of the keyword that finds it earliest, so each keyword is cut to n
    categories before the queries meet it.
    """
    named = flat_categories(tree).filter(F.col("category_id") != "").select("position", "category_id", "category_name")
    keywords = query_keywords(queries, 3)
    firsts = _keyword_hits(keywords, named, "category_name").groupBy("keyword", "category_id").agg(F.min("position").alias("position"))
    found = keywords.join(first_per_group(firsts, ["keyword"], [F.col("position").asc(), F.col("category_id").asc()], n), "keyword")
    once = found.groupBy("query_id", "category_id").agg(F.min("position").alias("position"))
    window = Window.partitionBy("query_id").orderBy("position")
    ranked = once.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)
    return ranked.select("query_id", "category_id", "rank")


def category_products(
    matched: DataFrame, products: DataFrame, queries: DataFrame, n: int = 10
) -> DataFrame:
    """Products of the matched categories, once each, that hold a keyword (two letters or more)."""
    keywords = F.filter(words(loose_text(F.col("query"))), lambda w: F.length(w) >= 2)
    asked = matched.join(queries.select("query_id", keywords.alias("_keywords")), "query_id")
    named = products.withColumn("_name", loose_text(F.col("name")))
    # Most products of a category hold none of the words, so the test comes before anything is sorted.
    relevant = named.join(asked, "category_id").filter(F.exists("_keywords", lambda w: F.contains("_name", w))).drop("_keywords", "_name")
    order = [F.col("rank").asc(), F.col("position").asc()]
    once = first_per_group(relevant, ["query_id", "product_id"], order)
    return first_per_group(once, ["query_id"], [*order, F.col("product_id").asc()], n)


def match_by_ean(queries: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers whose barcode is one of the query's codes."""
    codes = queries.select("query_id", F.explode(F.array_distinct("eans")).alias("ean"))
    return offers.join(codes, "ean")


def ean_first(ean_hits: DataFrame, text_hits: DataFrame) -> DataFrame:
    """Barcode hits of a query replace its text hits."""
    rest = text_hits.join(ean_hits.select("query_id").distinct(), "query_id", "left_anti")
    return ean_hits.unionByName(rest, allowMissingColumns=True)


def relaxations(queries: DataFrame, ladder: str = "prefix") -> DataFrame:
    """Shortened forms of each query, best first.

    "prefix" drops words from the end down to two; "tail" tries the whole query, then all but the
    first word.
    """
    text = F.trim(strip_accents(F.col("query")) if ladder == "prefix" else F.col("query"))
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(tokens)
    if ladder == "prefix":
        steps = F.when(
            n >= 2,
            F.transform(F.sequence(n, F.lit(2), F.lit(-1)), lambda k: F.slice(tokens, F.lit(1), k)),
        )
    else:
        steps = F.when(n > 1, F.array(tokens, F.slice(tokens, F.lit(2), n))).when(
            n == 1, F.array(tokens)
        )
    return queries.select("query_id", F.posexplode(steps).alias("step", "terms"))


def relaxed_match(
    queries: DataFrame, items: DataFrame, ladder: str = "prefix", n: int = 5, parts: int = 16
) -> DataFrame:
    """Items (one row per item_id) that hold all words of the longest form of the query with any hit, first n per query."""
    forms = relaxations(queries, ladder).withColumn(
        "terms", F.array_sort(F.array_distinct(words(search_text(F.array_join("terms", " ")))))
    ).filter(F.size("terms") > 0)
    # Equal forms of different queries are matched once, by items' numbers and words; other columns join the answer.
    asked = forms.select("terms").distinct()
    named = items.select("item_id", F.array_distinct(words(search_text(F.col("product_name")))).alias("_words"))
    by_word = named.withColumn("_word", F.explode("_words"))
    # The rarest word of a form picks the candidates, its other words are tested on those.
    frequency = by_word.groupBy("_word").agg(F.count("*").alias("_n"))
    anchors = (
        asked.withColumn("_word", F.explode("terms")).join(frequency, "_word")
        .groupBy("terms").agg(F.min(F.struct("_n", "_word")).alias("_rarest"))
        .select("terms", F.col("_rarest._word").alias("_word"), F.least(F.lit(parts), F.floor(F.col("_rarest._n") / CROWDED) + 1).cast("int").alias("_parts"))
    )
    # A word of very many items is dealt to several tasks, and the few forms that pick it are repeated for each.
    dealt = by_word.join(anchors.select("_word", "_parts").distinct(), "_word").withColumn("_salt", F.pmod(F.xxhash64("item_id"), F.col("_parts")).cast("int"))
    spread = anchors.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    hits = dealt.join(spread, ["_word", "_salt"]).filter(F.size(F.array_except("terms", "_words")) == 0)
    # No query needs more than n items of a form.
    first = first_per_group(hits.select("terms", "item_id"), ["terms"], [F.col("item_id").asc()], n)
    found = forms.join(first, "terms")
    best = found.groupBy("query_id").agg(F.min("step").alias("step"))
    return found.join(best, ["query_id", "step"]).drop("terms").join(items, "item_id")
