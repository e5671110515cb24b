"""Row contracts of the model tables and of the in-flight offer rows."""

from pyspark.sql import types as T

_MONEY = T.DecimalType(10, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


STORES = _struct(
    store_id=T.LongType(), name=T.StringType(), slug=T.StringType(), type=T.StringType(),
    website_url=T.StringType(), logo_url=T.StringType(), is_active=T.BooleanType(),
    free_shipping_threshold=_MONEY, shipping_note=T.StringType(),
)
PRODUCTS = _struct(
    product_id=T.LongType(), name=T.StringType(), slug=T.StringType(), description=T.StringType(),
    image_url=T.StringType(), category=T.StringType(), brand=T.StringType(), ean=T.StringType(),
    is_active=T.BooleanType(),
)
OBSERVATIONS = _struct(
    observation_id=T.StringType(), product_id=T.LongType(), store_id=T.LongType(), price=_MONEY,
    currency=T.StringType(), url=T.StringType(), source=T.StringType(), is_available=T.BooleanType(),
    package_size=T.IntegerType(), net_weight=_MONEY, net_weight_unit=T.StringType(),
    subscribe_price=_MONEY, shipping_cost=_MONEY, scraped_at=T.TimestampNTZType(),
)
TRACKED = _struct(user_id=T.LongType(), product_id=T.LongType(), created_at=T.TimestampNTZType())
ALERTS = _struct(
    alert_id=T.StringType(), user_id=T.LongType(), product_id=T.LongType(), target_price=_MONEY,
    is_active=T.BooleanType(), triggered_at=T.TimestampNTZType(), created_at=T.TimestampNTZType(),
)
RUNS = _struct(
    run_id=T.LongType(), store_id=T.LongType(), started_at=T.TimestampNTZType(),
    finished_at=T.TimestampNTZType(), status=T.StringType(), products_scraped=T.IntegerType(),
    error_message=T.StringType(),
)
CAPTURES = _struct(
    capture_id=T.LongType(), store_slug=T.StringType(), query_id=T.LongType(), url=T.StringType(),
    fetched_at=T.TimestampType(), body=T.StringType(),
)

TABLES = {
    "stores": STORES, "products": PRODUCTS, "observations": OBSERVATIONS,
    "tracked": TRACKED, "alerts": ALERTS, "runs": RUNS,
}

# Columns every offer row carries besides its query_id and seq (arrival order).
OFFER_COLUMNS = [
    "store_slug", "store_name", "product_name", "price", "subscribe_price", "currency", "image_url",
    "product_url", "is_available", "package_size", "net_weight", "net_weight_unit", "ean",
]

QUANTITY = _struct(
    package_size=T.IntegerType(), net_weight=T.DoubleType(), net_weight_unit=T.StringType(),
)
QUANTITY_DDL = "struct<package_size:int,net_weight:double,net_weight_unit:string>"

# Enum values in their declaration order, which is also their sort order.
STORE_TYPES = ["ONLINE", "PHYSICAL", "BOTH"]
PRICE_SOURCES = ["API", "SCRAPE", "MANUAL"]
RUN_STATUSES = ["RUNNING", "SUCCESS", "FAILED"]
