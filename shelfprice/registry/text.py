"""Titles, structured quantities, prices, labels and URLs."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.functions import labels, money, pricing, text, urls
from shelfprice.functions import structured_quantity as sq
from shelfprice.functions.quantity import legacy_package_size, with_quantity
from shelfprice.registry.ranking import euro_sql, weight_sql
from shelfprice.sources.tables import spread

_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def titles(spark, d):
    """One title per observed line: count n and weight w in one of fourteen notations."""
    n, w = F.col("n").cast("string"), F.col("w").cast("string")
    rows = t.table(spark, d, "lineitem").select(
        *_ID, F.col("l_quantity").cast("int").alias("n"), ((F.col("l_partkey") % 50 + 1) * 10).cast("int").alias("w"),
        ((F.col("l_orderkey") + F.col("l_linenumber")) % 14).cast("int").alias("notation"),
    )
    forms = [
        ("Atún claro ", n, "x", w, "g"), ("Yogur griego ", w, " g"), ("Pañales T5 ", n, " uds"),
        ("Agua pack de ", n, " botellas ", w, "cl"), ("Zumo ", n, " latas ", w, " ml"), ("Papel ", n, " rollos"),
        ("Toallitas ", n, " x ", w, " uds"), ("Queso ", n, " uds. ", w, " g"), ("Leche ", w, " litros"),
        ("Crema x", n, " ", w, "ml"), ("Jamón ", n, " lonchas x ", w, " g"), ("Flan ", n, "u x ", w, "g"),
        ("Braguitas ", n, "x", w), ("Sin cantidad",),
    ]
    title = F.when(F.lit(False), F.lit(None).cast("string"))
    for i, form in enumerate(forms):
        title = title.when(
            F.col("notation") == i, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in form])
        )
    return rows.withColumn("title", title)


def title_quantity(spark, d):
    return with_quantity(titles(spark, d), "title").select(*_ID, "title", "quantity.*")


def legacy_quantity(spark, d):
    return titles(spark, d).select(*_ID, legacy_package_size(F.col("title")).alias("package_size"))


def structured_quantity(spark, d):
    """Four structured payload shapes made from count and weight."""
    n, w = F.col("n").cast("double"), F.col("w").cast("double")
    kind = F.col("notation") % 4
    unit = F.when(F.col("l_partkey") % 2 == 0, "l").otherwise("kg")
    rows = titles(spark, d)
    found = (
        F.when(kind == 0, sq.from_size_format(unit, w / 100, n >= 10, n / 10, F.col("n")))
        .when(kind == 1, sq.from_conversion_factor(w, F.when(n > 25, "ud").otherwise("cl"), F.lit(None).cast("string")))
        .when(kind == 2, sq.from_measurement_ratio(F.when(n > 25, "Litro").otherwise("Unidad"), w))
        .otherwise(sq.from_content_size(F.concat(F.format_string("%.4f", w), F.lit(" Milliliter")), n))
    )
    return rows.withColumn("q", found).select(*_ID, "q.*")


def price_text_parse(spark, d):
    """Prices written as text in the shops' notations and read back."""
    cents = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100.0 + 0.5)
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    rows = spread(t.table(spark, d, "lineitem"), 100_000).select(*_ID, cents.alias("cents"), whole.alias("whole"), rest.alias("rest"))
    comma = F.concat("whole", F.lit(","), "rest", F.lit(" €"))
    dotted = F.concat(F.lit("PVP 1."), F.lpad(F.col("rest"), 3, "0"), F.lit(","), "rest", F.lit(" €"))
    return rows.select(
        *_ID,
        money.spanish_price(comma).alias("spanish"),
        money.spanish_price(F.concat("whole", F.lit("."), "rest")).alias("spanish_dot_lost"),
        money.cents_price(comma).alias("cents_text"),
        money.whole_and_fraction_price(F.concat("whole", F.lit(",")), F.col("rest")).alias("split_text"),
        money.whole_and_fraction_price(F.col("whole"), F.lit("")).alias("split_without_fraction"),
        money.comma_decimal_price(F.concat(F.lit("Desde "), comma)).alias("comma_text"),
        money.dotted_thousands_price(dotted).alias("dotted_text"),
        money.leading_number(F.concat("whole", F.lit("."), "rest", F.lit("EUR"))).alias("prefix"),
    )


def money_scaling(spark, d):
    price = F.col("l_extendedprice")
    return t.table(spark, d, "lineitem").select(
        *_ID,
        money.from_minor_units(F.floor(price)).alias("from_cents"),
        money.from_minor_units(F.floor(price), F.col("l_linenumber")).alias("from_minor"),
        money.round_half_up(price / F.col("l_quantity"), 2).alias("rounded"),
    )


def normalised_text(spark, d):
    """Whole document texts through every normaliser."""
    body = F.col("text")
    return t.table(spark, d, "documents").select(
        "doc_id", text.search_text(body).alias("search_text"), text.fold(text.plain_spaces(body)).alias("folded"),
        text.strip_accents(body).alias("bare"),
        F.length(text.loose_text(body)).alias("loose_length"),
    )


def slugs(spark, d):
    return t.table(spark, d, "documents").select("doc_id", text.slugify(F.col("text")).alias("slug"))


def title_texts(spark, d):
    rows = t.table(spark, d, "conversations")
    return rows.select(
        "conv_id", "turn", text.title_case(F.col("text")).alias("title_case"), text.truncate(F.col("text"), 40).alias("short"),
    )


def date_and_currency(spark, d):
    return t.table(spark, d, "orders").select(
        "o_orderkey", text.format_date(F.col("o_orderdate")).alias("day"),
        labels.us_currency(F.floor(F.col("o_totalprice"))).alias("amount"),
    )


def quantity_labels(spark, d):
    return t.observations(spark, d).select(
        "observation_id",
        labels.quantity_label(F.col("package_size"), F.col("net_weight") * 7, F.col("net_weight_unit")).alias("label"),
    )


def shipping_labels(spark, d):
    rows = t.observations(spark, d).join(t.stores(spark, d), "store_id")
    label = labels.shipping_label(F.col("shipping_cost"), F.col("free_shipping_threshold"), F.col("shipping_note"))
    return rows.select("observation_id", label.alias("label"))


def _categories(spark, d):
    key = F.col("product_id")
    return t.products(spark, d).withColumn(
        "category",
        F.when(key % 6 == 0, "Leche").when(key % 6 == 1, "Queso").when(key % 6 == 2, "PAÑALES")
        .when(key % 6 == 3, "agua con gas").when(key % 6 == 4, "toallitas bebé").otherwise(F.col("category")),
    ).withColumn("unit", F.when(key % 3 == 0, "g").when(key % 3 == 2, F.when(key % 2 == 1, "ml")))


def unit_labels(spark, d):
    return _categories(spark, d).select(
        "product_id", labels.unit_label(F.col("category"), F.col("unit")).alias("label"),
        labels.unit_label(F.col("category")).alias("category_label"),
    )


def display_labels(spark, d):
    """Mode headers and units, shown subscription price, store type."""
    mode = F.element_at(F.array(*[F.lit(m) for m in pricing.MODES]), (F.col("store_id") % 4 + 1).cast("int"))
    rows = t.observations(spark, d).withColumn("mode", mode)
    return rows.select(
        "observation_id", pricing.mode_header(F.col("mode")).alias("header"),
        pricing.mode_unit(F.col("mode")).alias("unit"),
        labels.shown_subscribe_price(F.col("subscribe_price"), F.col("price")).alias("shown_subscribe"),
        labels.header_suffix(F.col("mode"), F.lit("ud.")).alias("suffix"),
        labels.comparable_text(F.col("price"), F.col("mode")).alias("price_text"),
    )


def url_parts(spark, d):
    url = F.col("url")
    return t.table(spark, d, "pages").select(
        "page_id", urls.host(url).alias("host"), urls.is_url(url).alias("is_url"),
        urls.query_encode(url).alias("encoded"),
        urls.without_port(F.regexp_replace(url, "^(https?://[^/]+)", "$1:443")).alias("without_port"),
        urls.absolute_url(F.regexp_replace(url, "^https?://[^/]+", ""), "https://shop.example").alias("absolute"),
        urls.item_url(
            F.concat(F.lit("/x/dp/"), F.lpad(F.col("page_id").cast("string"), 10, "0"), F.lit("/ref=1")),
            "https://shop.example",
        ).alias("item_url"),
    )


QUERIES = {
    f.__name__: f
    for f in [
        title_quantity, legacy_quantity, structured_quantity, price_text_parse, money_scaling, normalised_text, slugs,
        title_texts, date_and_currency, quantity_labels, shipping_labels, unit_labels, display_labels, url_parts,
    ]
}

_KEY = ", ".join(_ID)
_TITLES = f"""SELECT {_KEY}, CAST(l_quantity AS INTEGER) AS n, CAST((l_partkey % 50 + 1) * 10 AS INTEGER) AS w,
  CAST((l_orderkey + l_linenumber) % 14 AS INTEGER) AS k FROM lineitem"""
_MONEY = f"""SELECT {_KEY}, CAST(floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS c
  FROM lineitem"""
_BARE = "strip_accents(lower(text))"
_BIG_WEIGHT = """CASE WHEN net_weight * 7 >= 1000 THEN
    replace(rtrim(rtrim(CAST(CAST(net_weight * 7 / 1000 AS DECIMAL(10,2)) AS VARCHAR), '0'), '.'), '.', ',')
    || CASE net_weight_unit WHEN 'g' THEN ' kg' ELSE ' L' END
  ELSE """ + weight_sql("net_weight * 7", "net_weight_unit") + " END"

SQL = {
    "title_quantity": f"""
      SELECT {_KEY},
        CASE k WHEN 0 THEN 'Atún claro ' || n || 'x' || w || 'g' WHEN 1 THEN 'Yogur griego ' || w || ' g'
          WHEN 2 THEN 'Pañales T5 ' || n || ' uds' WHEN 3 THEN 'Agua pack de ' || n || ' botellas ' || w || 'cl'
          WHEN 4 THEN 'Zumo ' || n || ' latas ' || w || ' ml' WHEN 5 THEN 'Papel ' || n || ' rollos'
          WHEN 6 THEN 'Toallitas ' || n || ' x ' || w || ' uds' WHEN 7 THEN 'Queso ' || n || ' uds. ' || w || ' g'
          WHEN 8 THEN 'Leche ' || w || ' litros' WHEN 9 THEN 'Crema x' || n || ' ' || w || 'ml'
          WHEN 10 THEN 'Jamón ' || n || ' lonchas x ' || w || ' g' WHEN 11 THEN 'Flan ' || n || 'u x ' || w || 'g'
          WHEN 12 THEN 'Braguitas ' || n || 'x' || w ELSE 'Sin cantidad' END AS title,
        CASE WHEN k IN (0, 4, 9) AND n >= 2 THEN n WHEN k IN (2, 3, 5, 11) THEN n WHEN k = 6 THEN n * w
          WHEN k = 7 AND n >= 20 THEN n
          WHEN k = 12 AND n BETWEEN 2 AND 24 AND w BETWEEN 20 AND 250 THEN n * w END AS package_size,
        CAST(CASE WHEN k IN (0, 1, 4, 9, 10, 11) OR (k = 7 AND n < 20) THEN w WHEN k = 3 THEN w * 10
          WHEN k = 8 THEN w * 1000 END AS DOUBLE) AS net_weight,
        CASE WHEN k IN (0, 1, 10, 11) OR (k = 7 AND n < 20) THEN 'g' WHEN k IN (3, 4, 8, 9) THEN 'ml' END
          AS net_weight_unit
      FROM ({_TITLES})""",
    "legacy_quantity": f"""
      SELECT {_KEY}, CASE WHEN k = 2 THEN n WHEN k = 7 THEN n
        WHEN k IN (6, 12) AND n BETWEEN 2 AND 9 AND w BETWEEN 20 AND 250 THEN n * w
        WHEN k = 6 THEN w END AS package_size
      FROM ({_TITLES})""",
    "structured_quantity": f"""
      SELECT {_KEY},
        CASE k % 4 WHEN 0 THEN CASE WHEN n >= 10 THEN n END WHEN 1 THEN CASE WHEN n > 25 THEN w END
          WHEN 2 THEN CASE WHEN n <= 25 THEN w END ELSE CASE WHEN n > 1 THEN n END END AS package_size,
        CASE k % 4
          WHEN 0 THEN floor(CASE WHEN n >= 10 THEN n / 10.0::DOUBLE ELSE w / 100.0::DOUBLE END * 1000.0::DOUBLE + 0.5::DOUBLE)
          WHEN 1 THEN CASE WHEN n <= 25 THEN w * 10.0::DOUBLE END WHEN 2 THEN CASE WHEN n > 25 THEN w * 1000.0::DOUBLE END
          ELSE w::DOUBLE END AS net_weight,
        CASE k % 4 WHEN 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'ml' ELSE 'g' END
          WHEN 1 THEN CASE WHEN n <= 25 THEN 'ml' END WHEN 2 THEN CASE WHEN n > 25 THEN 'ml' END ELSE 'ml' END
          AS net_weight_unit
      FROM ({_TITLES})""",
    "price_text_parse": f"""
      SELECT {_KEY}, c / 100.0::DOUBLE AS spanish, CAST(c AS DOUBLE) AS spanish_dot_lost,
        c / 100.0::DOUBLE AS cents_text, c / 100.0::DOUBLE AS split_text,
        CAST(c // 100 AS DOUBLE) AS split_without_fraction, c / 100.0::DOUBLE AS comma_text,
        (100000 + c % 100 * 101) / 100.0::DOUBLE AS dotted_text, c / 100.0::DOUBLE AS prefix
      FROM ({_MONEY})""",
    "money_scaling": f"""
      SELECT {_KEY}, floor(l_extendedprice) / 100.0::DOUBLE AS from_cents,
        floor(l_extendedprice) / pow(10.0::DOUBLE, l_linenumber) AS from_minor,
        floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS rounded
      FROM lineitem""",
    "normalised_text": f"""
      SELECT doc_id, trim(regexp_replace({_BARE}, '[^a-z0-9]+', ' ', 'g')) AS search_text,
        regexp_replace({_BARE}, '[\\t\\n\\r\\x0b\\x0c]', ' ', 'g') AS folded,
        strip_accents(text) AS bare,
        CAST(length(trim(regexp_replace({_BARE}, '[^a-z0-9]', ' ', 'g'))) AS INTEGER) AS loose_length
      FROM documents""",
    "slugs": f"""
      SELECT doc_id, substring(regexp_replace(regexp_replace({_BARE}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 1, 200)
        AS slug FROM documents""",
    "title_texts": r"""
      SELECT conv_id, turn,
        array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''),
          lambda w: CASE WHEN w[1] = 'ß' THEN 'SS' ELSE upper(w[1]) END || w[2:]), ' ') AS title_case,
        CASE WHEN length(text) <= 40 THEN text ELSE substring(text, 1, 39) || '…' END AS short
      FROM conversations""",
    "date_and_currency": """
      SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') AS day,
        '$' || format('{:,.2f}', floor(o_totalprice)) AS amount FROM orders""",
    "quantity_labels": with_ctes(f"""
      SELECT observation_id, CASE
          WHEN net_weight IS NOT NULL AND package_size > 1 THEN package_size || '×' || {_BIG_WEIGHT}
          WHEN net_weight IS NOT NULL THEN {_BIG_WEIGHT}
          WHEN package_size IS NOT NULL THEN package_size || ' uds' ELSE '—' END AS label
      FROM observations""", "observations"),
    "shipping_labels": with_ctes(f"""
      SELECT observation_id, CASE WHEN shipping_cost = 0 THEN 'Gratis'
          WHEN shipping_cost > 0 THEN {euro_sql('shipping_cost')}
          WHEN free_shipping_threshold IS NOT NULL THEN 'Gratis desde ' || {euro_sql('free_shipping_threshold')}
          WHEN shipping_note <> '' THEN shipping_note ELSE '—' END AS label
      FROM observations JOIN stores USING (store_id)""", "observations", "stores"),
    "unit_labels": with_ctes("""
      SELECT product_id, CASE product_id % 6 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'pañal' WHEN 3 THEN 'L'
          WHEN 4 THEN 'toallita' ELSE CASE WHEN product_id % 3 = 2 AND product_id % 2 = 1 THEN 'l' ELSE 'ud.' END END
          AS label,
        CASE product_id % 6 WHEN 0 THEN 'ml' WHEN 1 THEN 'g' WHEN 2 THEN 'pañal' WHEN 3 THEN 'L'
          WHEN 4 THEN 'toallita' ELSE 'ud.' END AS category_label
      FROM products""", "products"),
    "display_labels": with_ctes(f"""
      SELECT observation_id,
        CASE store_id % 4 WHEN 0 THEN '€/kg' WHEN 1 THEN '€/l' WHEN 2 THEN '€/ud' ELSE '€/pack' END AS header,
        CASE store_id % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'ud' ELSE 'pack' END AS unit,
        CASE WHEN subscribe_price < price THEN subscribe_price END AS shown_subscribe,
        CASE store_id % 4 WHEN 0 THEN 'por kg' WHEN 1 THEN 'por litro' WHEN 2 THEN 'por ud.' ELSE '' END AS suffix,
        CASE WHEN store_id % 4 = 2 THEN {euro_sql('price', 3)} ELSE {euro_sql('price')} END AS price_text
      FROM observations""", "observations"),
    "url_parts": r"""
      SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, true AS is_url,
        replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')
          AS encoded, url AS without_port,
        'https://shop.example' || regexp_replace(url, '^https?://[^/]+', '') AS absolute,
        'https://shop.example/dp/' || lpad(CAST(page_id AS VARCHAR), 10, '0') AS item_url
      FROM pages""",
}
