"""Display labels: quantities, money, shipping, units, statuses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category (lower case) and the unit its price is shown per.
CATEGORY_UNIT = {
    "pañales": "pañal", "toallitas": "toallita", "toallitas bebé": "toallita", "leche infantil": "ml",
    "leche maternizada": "ml", "papillas bebé": "g", "papillas": "g",
    "leche": "ml", "lácteos": "ml", "yogur": "ud.", "queso": "g", "mantequilla": "g", "nata": "ml", "kéfir": "ml",
    "bebidas vegetales": "ml", "bebidas": "ml",
    "agua": "L", "refrescos": "ml", "bebidas carbonatadas": "ml", "zumos": "ml", "zumo": "ml", "agua con gas": "L",
    "bebidas energéticas": "ml", "cerveza": "ml", "vino": "ml", "cava": "ml", "sidra": "ml",
    "bebidas alcohólicas": "ml", "licores": "ml", "bebidas calientes": "g", "café": "g", "infusiones": "g",
    "aceite": "ml", "aceite de oliva": "ml", "vinagre": "ml", "salsas": "ml", "salsas y condimentos": "ml",
    "cereales": "g", "pasta": "g", "arroz": "g", "legumbres": "g", "harina y levadura": "g", "harina": "g",
    "azúcar": "g", "sal": "g", "frutos secos": "g", "muesli": "g", "copos de avena": "g", "galletas": "g", "pan": "g",
    "pan de molde": "g", "tostadas": "g", "snacks": "g", "aperitivos y snacks": "g", "chocolates": "g",
    "chocolates y dulces": "g", "helados y postres": "g",
    "conservas": "g", "conservas de pescado": "g", "conservas vegetales": "g", "atún": "g", "sardinas": "g",
    "carne": "g", "carne y aves": "g", "pollo": "g", "ternera": "g", "cerdo": "g", "embutidos": "g",
    "charcutería": "g", "pescado": "g", "pescado y marisco": "g", "marisco": "g",
    "frutas": "g", "verduras": "g", "frutas y verduras": "g", "fruta fresca": "g", "verdura fresca": "g",
    "mermeladas": "g", "mermelada": "g", "miel": "g",
    "higiene": "ud.", "higiene personal": "ud.", "gel": "ml", "gel de ducha": "ml", "champú": "ml",
    "acondicionador": "ml", "pasta de dientes": "ml", "desodorante": "ml", "crema": "ml", "crema corporal": "ml",
    "crema facial": "ml", "jabón": "ml", "compresas": "ud.", "tampones": "ud.", "papel higiénico": "ud.",
    "pañuelos": "ud.", "pañuelos faciales": "ud.",
    "limpieza": "ud.", "limpieza hogar": "ud.", "higiene del hogar": "ud.", "detergente": "ml",
    "detergente ropa": "ml", "detergente lavavajillas": "ml", "lavavajillas": "ml", "suavizante": "ml",
    "lejía y desinfectantes": "ml", "lejía": "ml", "limpiadores multiusos": "ml", "bolsas de basura": "ud.",
    "papel de cocina": "ud.",
}
CATEGORY_UNITS = {unit: [c for c, u in CATEGORY_UNIT.items() if u == unit] for unit in dict.fromkeys(CATEGORY_UNIT.values())}
DASH = "—"


def spanish_number(value: Column, digits: int, trim: bool = False) -> Column:
    """Decimal comma, dots between thousands from 10 000 upwards; half rounds away from zero.

    With trim, trailing zero decimals are dropped.
    """
    rounded = F.round(value.cast("double"), digits)
    grouped = F.translate(F.format_number(rounded, digits), ",.", ".,")
    text = F.when(F.abs(rounded) < 10000, F.regexp_replace(grouped, r"\.", "")).otherwise(grouped)
    return F.regexp_replace(text, ",?0+$", "") if trim and digits else text


def euros(value: Column, digits: int = 2) -> Column:
    """Spanish money text; the amount and the sign are separated by a no-break space."""
    return F.concat(spanish_number(value, digits), F.lit("\u00a0€"))


def comparable_text(value: Column, mode: Column) -> Column:
    """Three decimals for prices per item, two otherwise."""
    return F.when(mode == "perUnit", euros(value, 3)).otherwise(euros(value, 2))


def plain_number(value: Column) -> Column:
    """Shortest text of a number: integers without a decimal point."""
    number = value.cast("double")
    return F.when(
        number == F.floor(number), F.floor(number).cast("string")
    ).otherwise(number.cast("string"))


def weight_text(value: Column, unit: Column) -> Column:
    """"500g", "1,5 kg", "330 ml", "1,5 L"."""
    number = value.cast("double")
    big = number >= 1000
    # A whole number of thousands has no decimals, so only then may trailing zeros be cut.
    thousands = F.round(number / 1000.0, 2)
    scaled = F.when(thousands == F.floor(thousands), spanish_number(thousands, 0)).otherwise(
        spanish_number(thousands, 2, trim=True)
    )
    return (
        F.when(unit.isNull(), F.lit(None).cast("string"))
        .when(big & (unit == "g"), F.concat(scaled, F.lit(" kg")))
        .when(big, F.concat(scaled, F.lit(" L")))
        .when(unit == "g", F.concat(plain_number(number), F.lit("g")))
        .otherwise(F.concat(plain_number(number), F.lit(" ml")))
    )


def quantity_label(package_size: Column, net_weight: Column, unit: Column) -> Column:
    """"6×330 ml", "500g", "44 uds" or a dash."""
    weight = weight_text(net_weight, unit)
    known = net_weight.isNotNull() & unit.isNotNull()
    return (
        F.when(known & (package_size > 1), F.concat(package_size.cast("string"), F.lit("×"), weight))
        .when(known, weight)
        .when(package_size.isNotNull(), F.concat(package_size.cast("string"), F.lit(" uds")))
        .otherwise(F.lit(DASH))
    )


def shipping_label(cost: Column, threshold: Column, note: Column) -> Column:
    return (
        F.when(cost == 0, F.lit("Gratis"))
        .when(cost > 0, euros(cost))
        .when(threshold.isNotNull(), F.concat(F.lit("Gratis desde "), euros(threshold)))
        .when(note != "", note)
        .otherwise(F.lit(DASH))
    )


def unit_label(category: Column, unit: Column | None = None) -> Column:
    """Unit of a category, else of the weight label, else a single item."""
    key = F.lower(category)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, categories in CATEGORY_UNITS.items():
        out = out.when(key.isin(*categories), F.lit(label))
    if unit is not None:
        out = out.when(unit == "g", F.lit("kg")).when(unit == "ml", F.lit("l"))
    return out.otherwise(F.lit("ud."))


def header_suffix(mode: Column, unit: Column) -> Column:
    """Text after the lowest price in a product header."""
    return (
        F.when(mode == "per100g", F.lit("por kg"))
        .when(mode == "per100ml", F.lit("por litro"))
        .when(mode == "perUnit", F.concat(F.lit("por "), unit))
        .otherwise(F.lit(""))
    )


def status_label(status: Column) -> Column:
    return (
        F.when(status == "SUCCESS", F.lit("OK"))
        .when(status == "FAILED", F.lit("Error"))
        .when(status == "RUNNING", F.lit("Activo"))
        .otherwise(F.lit("Sin datos"))
    )


def store_type_label(kind: Column) -> Column:
    return (
        F.when(kind == "PHYSICAL", F.lit("Supermercado / Tienda física"))
        .when(kind == "ONLINE", F.lit("Tienda online"))
        .otherwise(F.lit("Híbrido"))
    )


def store_type_rank(kind: Column) -> Column:
    """Stores of a type sort in the order ONLINE, PHYSICAL, BOTH."""
    return F.when(kind == "ONLINE", 0).when(kind == "PHYSICAL", 1).otherwise(2)


def shown_subscribe_price(subscribe: Column, price: Column) -> Column:
    """The subscription price is shown only when it is below the price."""
    return F.when(subscribe < price, subscribe)


def us_currency(value: Column) -> Column:
    rounded = F.round(value.cast("double"), 2)
    text = F.concat(F.lit("$"), F.format_number(F.abs(rounded), 2))
    return F.when(rounded < 0, F.concat(F.lit("-"), text)).otherwise(text)
