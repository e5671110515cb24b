"""Comparable prices, modes, ordering and labels."""

from pyspark.sql import functions as F

from shelfprice.functions import labels, money, pricing, text, urls
from shelfprice.operators.offers import comparison_mode, lowest_unit_price, rank_offers

ITEMS = [
    ("diaper44", "diapers", 18.0, None, 44, None, None, None),
    ("diaper22", "diapers", 10.0, None, 22, None, None, None),
    ("diaper48sub", "diapers", 20.0, 17.0, 48, None, None, None),
    ("milk1L", "milk", 1.2, None, None, 1000.0, "ml", None),
    ("milk6L", "milk", 6.5, None, 6, 1000.0, "ml", None),
    ("rice1kg", "rice", 1.5, None, None, 1000.0, "g", None),
    ("rice5kg", "rice", 5.0, None, None, 5000.0, "g", None),
    ("noData", "none", 3.99, None, None, None, None, None),
    ("tieG", "tie", 2.0, None, None, 500.0, "g", None),
    ("tieUnit", "tie", 3.0, None, 4, None, None, 1.0),
    ("mixed1", "mixed", 13.99, None, 40, None, None, 4.99),
    ("mixed2", "mixed", 9.0, None, 30, None, None, None),
    ("mixed3", "mixed", 2.0, None, None, None, None, None),
    ("mixed4", "mixed", 1.0, None, None, None, None, None),
]
SCHEMA = (
    "seq string, query_id string, price double, subscribe_price double, package_size int, net_weight double,"
    " net_weight_unit string, shipping_cost double"
)


def items(spark):
    return spark.createDataFrame(ITEMS, SCHEMA)


def test_modes(spark):
    got = {r.query_id: r["mode"] for r in comparison_mode(items(spark), ["query_id"]).collect()}
    assert got == {
        "diapers": "perUnit", "milk": "per100ml", "rice": "per100g", "none": "rawPrice", "tie": "per100g",
        "mixed": "perUnit",
    }


def test_unit_prices_and_order(spark):
    rows = rank_offers(items(spark)).collect()
    unit = {r.seq: r.unit_price for r in rows}
    assert unit["diaper44"] == 18 / 44 and unit["diaper48sub"] == 17 / 48
    assert unit["milk6L"] == 6.5 / 6000 * 1000 and unit["rice5kg"] == 1.0
    assert unit["mixed1"] == (13.99 + 4.99) / 40 and unit["noData"] == 3.99 and unit["tieUnit"] is None
    mixed = sorted((r for r in rows if r.query_id == "mixed"), key=lambda r: r.position)
    assert [r.seq for r in mixed] == ["mixed2", "mixed1", "mixed4", "mixed3"]
    assert [r.is_best_unit for r in mixed] == [True, False, False, False]


def test_lowest_without_shipping(spark):
    got = {r.query_id: r.lowest_unit_price for r in lowest_unit_price(items(spark), ["query_id"], shipping=False).collect()}
    assert got["mixed"] == 9.0 / 30 and got["none"] == 3.99


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first().v


def test_labels(spark):
    lit = F.lit
    null = F.lit(None)
    q = labels.quantity_label
    assert one(spark, q(lit(6), lit(330.0), lit("ml"))) == "6×330 ml"
    assert one(spark, q(null, lit(1500.0), lit("ml"))) == "1,5 L"
    assert one(spark, q(lit(1), lit(500.0), lit("g"))) == "500g"
    assert one(spark, q(lit(44), null.cast("double"), null.cast("string"))) == "44 uds"
    assert one(spark, q(null.cast("int"), null.cast("double"), null.cast("string"))) == "—"
    assert one(spark, labels.weight_text(lit(100000.0), lit("g"))) == "100 kg"
    assert one(spark, labels.euros(lit(1234.5))) == "1234,50 €"
    assert one(spark, labels.euros(lit(12345.678))) == "12.345,68 €"
    assert one(spark, labels.comparable_text(lit(0.4091), lit("perUnit"))) == "0,409 €"
    assert one(spark, labels.unit_label(lit("Pañales"))) == "pañal"
    assert one(spark, labels.unit_label(lit("otra"), lit("ml"))) == "l"
    assert one(spark, labels.us_currency(lit(-1234.5))) == "-$1,234.50"


def test_price_texts(spark):
    lit = F.lit
    assert one(spark, money.spanish_price(lit("12,99 €"))) == 12.99
    assert one(spark, money.spanish_price(lit("12.99"))) == 1299.0
    assert one(spark, money.spanish_price(lit("gratis"))) is None
    assert one(spark, money.cents_price(lit("22,95 €"))) == 22.95
    assert one(spark, money.cents_price(lit("1.299,99"))) == 1.29
    assert one(spark, money.whole_and_fraction_price(lit("1.299,"), lit("50"))) == 1299.5
    assert one(spark, money.whole_and_fraction_price(lit("7"), lit(""))) == 7.0
    assert one(spark, money.whole_and_fraction_price(lit(""), lit("50"))) is None
    assert one(spark, money.dotted_thousands_price(lit("PVP 1.299,50 €"))) == 1299.5
    assert one(spark, money.comma_decimal_price(lit("Desde 3,25 €"))) == 3.25
    assert one(spark, money.leading_number(lit("12abc"))) == 12.0
    assert one(spark, money.round_half_up(lit(1.0049999), 2)) == 1.0


def test_texts_and_urls(spark):
    lit = F.lit
    assert one(spark, text.slugify(lit("Pañales Dodot Sensitive Talla 5"))) == "panales-dodot-sensitive-talla-5"
    assert one(spark, text.search_text(lit("  Café, ÑANDÚ 1,5 L "))) == "cafe nandu 1 5 l"
    assert one(spark, text.title_case(lit(" leche  entera "))) == "Leche Entera"
    assert one(spark, text.truncate(lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.fold(lit("éǕ"))) == "eu"
    assert one(spark, urls.host(lit("https://u@Shop.example:80/x"))) == "shop.example"
    assert one(spark, urls.item_code(lit("/x/dp/B012345678/ref"))) == "B012345678"
    assert one(spark, urls.item_code(lit("/x"))) is None
    assert one(spark, urls.query_encode(lit("a b&ñ(1)"))) == "a%20b%26%C3%B1(1)"
