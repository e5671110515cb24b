"""Golden relevance and variant cases, and the relevance join against testing every pair."""

import random

from pyspark.sql import functions as F

from shelfprice.functions.relevance import is_relevant
from shelfprice.operators.offers import best_per_store, best_per_store_by_variant, filter_variant_conflicts
from shelfprice.plans.matching import match_names

CASES = [
    ("Dodot Sensitive Extra Talla 5 44 uds", "dodot sensitive talla 5", True),
    ("Pampers Baby Dry Talla 5", "dodot sensitive talla 5", False),
    ("Dodot Sensitive Extra Talla 4 48 uds", "dodot sensitive talla 5", False),
    ("Agua mineral Bezoya 1,5 L", "bezoya", True),
    ("Bezoya agua con gas 750 ml", "agua con gas bezoya", True),
    ("Dodot Aqua & Piel Bebé Toallitas 64 uds", "dodot bebé toallitas pure aqua 48", False),
    ("Dodot Pure Aqua Bebé Toallitas 48 uds", "dodot bebé toallitas pure aqua 48", True),
    ("Danone Activia Fresa 4x125g", "danone activia natural", False),
    ("Danone Activia Natural 4x125g", "danone activia natural", True),
    ("Dodot Sensitive T5 44 uds", "dodot talla 5", True),
    ("Dodot (5-10 kg) talla 3", "dodot talla 5", False),
    ("Movil Galaxy S5", "galaxy 5", True),
    ("Movil Galaxy 54", "galaxy 5", False),
    ("Peso 5-10 kg", "peso 5", False),
    ("cualquier cosa", "de la", True),
    ("cualquier cosa", "", True),
]


def test_golden(spark):
    df = spark.createDataFrame(CASES, "name string, query string, want boolean")
    rows = df.select("*", is_relevant(F.col("name"), F.col("query")).alias("got")).collect()
    assert [(r.name, r.query) for r in rows if r.got != r.want] == []


VARIANTS = {
    "agua bezoya": (["Bezoya agua sin gas 1,5 L", "Bezoya agua con gas 750 ml", "Bezoya agua mineral 1 L"], [0, 2]),
    "font vella": (["Font Vella agua mineral 1,5 L", "Font Vella carbonatada 750 ml"], [0]),
    "vichy catalan": (["Vichy Catalan con gas 1 L", "Vichy Catalan con gas 1,2 L", "Perrier sparkling water"], [0, 1, 2]),
    "agua con gas bezoya": (["Bezoya con gas 750 ml", "Bezoya sin gas 1,5 L", "Bezoya mineral 1 L"], [0, 2]),
    "agua sin gas bezoya": (["Bezoya sin gas 1,5 L", "Bezoya con gas 750 ml"], [0]),
}


def _offers(spark):
    rows = [
        (i, query, n, f"shop{n}", title, 1.0 + n, None, None)
        for i, (query, (titles, _)) in enumerate(VARIANTS.items()) for n, title in enumerate(titles)
    ]
    return spark.createDataFrame(
        rows, "query_id long, query string, seq long, store_slug string, product_name string, price double,"
        " subscribe_price double, package_size int",
    )


def test_variants(spark):
    kept = filter_variant_conflicts(_offers(spark)).collect()
    got = {q: sorted(r.seq for r in kept if r.query == q) for q in VARIANTS}
    assert got == {q: want for q, (_, want) in VARIANTS.items()}


def test_one_pass_equals_filter_then_best(spark):
    random.seed(3)
    titles = ["Agua", "Agua con gas", "Agua sin gas", "Agua sparkling"]
    rows = [
        (random.randrange(30), random.choice(["agua", "agua con gas"]), i, f"s{random.randrange(4)}",
         random.choice(titles), float(random.randrange(1, 9)), random.choice([None, 2.0]), random.choice([None, 2, 3]))
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, _offers(spark).schema)
    # One query text per query.
    df = df.withColumn("query", F.when(F.col("query_id") % 2 == 0, "agua").otherwise("agua con gas"))
    two_steps = best_per_store(filter_variant_conflicts(df)).select("query_id", "store_slug", "seq")
    one_pass = best_per_store_by_variant(df).select("query_id", "store_slug", "seq")
    assert sorted(map(tuple, two_steps.collect())) == sorted(map(tuple, one_pass.collect()))


def test_join_equals_all_pairs(spark):
    random.seed(7)
    vocabulary = [
        "dodot", "pure", "aqua", "leche", "entera", "natural", "talla", "5", "55", "t5", "12", "pan", "ab", "x", "y",
        "café", "bio", "panal", "sensitive", "con", "gas", "agua", "mineral", "(5-10", "kg)", "Ñora",
    ]

    def phrase(least, most):
        return " ".join(random.choices(vocabulary, k=random.randint(least, most)))

    queries = [(i, phrase(0, 7)) for i in range(60)] + [(60, ""), (61, "de la"), (62, "5"), (63, "agua agua mineral bio pan")]
    # One phrase makes up a third of the names.
    names = [(i, phrase(1, 9) if i % 3 else "agua mineral natural pan bio talla 5") for i in range(150)]
    q = spark.createDataFrame(queries, "query_id long, query string")
    n = spark.createDataFrame(names, "name_id long, name string")
    every = q.crossJoin(n).filter(is_relevant(F.col("name"), F.col("query"))).select("query_id", "name_id")
    found = match_names(q, n).select("query_id", "name_id")
    got = sorted(map(tuple, found.collect()))
    assert got == sorted(map(tuple, every.collect()))
    assert len(got) == len(set(got)) > 300
