"""Category matching, barcode resolution, fallbacks and relaxed queries."""

from pyspark.sql import functions as F

from shelfprice.operators import resolve

TREE = [
    (1, "1", "Bebé", [("11", "Toallitas y pañales"), ("12", "Alimentación infantil")]),
    (2, "2", "Agua y refrescos", [("21", "Agua"), ("22", "Isotónico")]),
    (3, "3", "Huevos, leche y mantequilla", [("31", "Leche y bebidas vegetales"), ("32", "Huevos")]),
    (4, "4", "Postres y yogures", [("41", "Yogures naturales")]),
]
QUERIES = [
    (1, "toallitas dodot"), (2, "leche entera"), (3, "bebe alimentacion"), (4, "pañales talla 5"),
    (5, "aspirina ibuprofeno"), (6, "agua mineral"), (7, "yogur natural"), (8, "de y"), (9, "agua leche yogur bebe"),
]


def test_categories(spark):
    tree = spark.createDataFrame(
        TREE, "position int, id string, name string, categories array<struct<id:string,name:string>>"
    )
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    rows = resolve.match_categories(tree, queries).orderBy("query_id", "rank").collect()
    got = {q: [r.category_id for r in rows if r.query_id == q] for q, _ in QUERIES}
    assert got == {
        1: ["11"], 2: ["3", "31"], 3: ["1", "12"], 4: ["11"], 5: [], 6: ["2", "21"], 7: ["4", "41"], 8: [],
        9: ["1", "2", "21"],
    }
    assert resolve.match_categories(tree.limit(0), queries).count() == 0


def test_eans(spark):
    queries = spark.createDataFrame([(1, "leche"), (2, "pan")], "query_id int, query string")
    hits = spark.createDataFrame(
        [(1, i, 100 - i, code, "" if i == 0 else "x", "Milk") for i, code in enumerate(
            ["12345678", "bad", "1234567", "123456789012345", "8400000000001", None, "8400000000002", "8400000000003",
             "8400000000004", "8400000000005", "8400000000006"])],
        "query_id int, hit_id int, scans int, code string, name_es string, name string",
    )
    rows = {r.query_id: r for r in resolve.resolve_eans(queries, hits).collect()}
    # Ten rows are looked at and five codes kept.
    assert rows[1].eans == ["12345678", "8400000000001", "8400000000002", "8400000000003", "8400000000004"]
    assert rows[1].canonical_name == "Milk"
    assert rows[2].eans == [] and rows[2].canonical_name == "pan"


def test_barcodes_first(spark):
    hits = spark.createDataFrame([(1, "e1")], "query_id int, offer string")
    text = spark.createDataFrame([(1, "t1"), (2, "t2"), (2, "t3")], "query_id int, offer string")
    assert sorted(map(tuple, resolve.ean_first(hits, text).collect())) == [(1, "e1"), (2, "t2"), (2, "t3")]


def test_relaxation(spark):
    queries = spark.createDataFrame(
        [(1, "leche entera pascual"), (2, "pan integral raro"), (3, "sola"), (4, "café molido suave")], "query_id int, query string"
    )
    items = spark.createDataFrame(
        [(i, n) for i, n in enumerate(["Leche entera 1 L", "Leche Pascual entera", "Pan de molde integral", "Cafe molido", "sola"])],
        "item_id int, product_name string",
    )
    rows = resolve.relaxed_match(queries, items).collect()
    assert sorted((r.query_id, r.step, r.item_id) for r in rows) == [(1, 0, 1), (2, 1, 2), (4, 1, 3)]
    tail = resolve.relaxed_match(queries, items, "tail").collect()
    assert sorted((r.query_id, r.step, r.item_id) for r in tail) == [(1, 0, 1), (3, 0, 4)]


def test_longest_form_is_kept_whole(spark):
    items = spark.range(9).select(F.col("id").alias("item_id"), F.lit("pan blanco").alias("product_name"))
    queries = spark.createDataFrame([(1, "pan blanco azul"), (2, "pan blanco")], "query_id int, query string")
    rows = resolve.relaxed_match(queries, items).collect()
    assert sorted((r.query_id, r.item_id) for r in rows) == [(q, i) for q in (1, 2) for i in range(5)]
