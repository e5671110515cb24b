"""Ingest jobs. Each takes tables and gives the changed tables and a report, all as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfprice.functions.text import slugify
from shelfprice.functions.urls import host, is_url
from shelfprice.operators import dml, history, ops
from shelfprice.operators.groups import first_per_group
from shelfprice.operators.validate import validate_track_requests
from shelfprice.plans.search import search_offers


@dataclass
class JobResult:
    """Changed tables by name, the new rows, and reports by name.

    new_rows are those of the job's main table, inserted the new rows of every table it adds to. All are lazy: store the
    new rows first and make the reports from what was stored, or cache them.
    """

    tables: dict[str, DataFrame]
    new_rows: DataFrame
    reports: dict[str, DataFrame]
    inserted: dict[str, DataFrame] = field(default_factory=dict)


def _matches(products: DataFrame, offers: DataFrame, stores: DataFrame) -> DataFrame:
    """Search results of every active product, in known active stores."""
    queries = products.filter("is_active").select(
        F.col("product_id").alias("query_id"), F.col("name").alias("query")
    )
    found = search_offers(queries, offers).withColumnRenamed("query_id", "product_id")
    known = stores.filter("is_active").select("store_id", F.col("slug").alias("store_slug"))
    return found.join(known, "store_slug").withColumn("url", F.col("product_url"))


def discover(
    products: DataFrame, offers: DataFrame, stores: DataFrame, observations: DataFrame,
    moment: str, cleanup: bool = False,
) -> JobResult:
    """Search all active products at once and append one observation per matched store."""
    active = products.filter("is_active")
    base = observations
    reports = {}
    if cleanup:
        base, deleted = dml.delete_scraped(observations, active)
        reports["deleted"] = deleted.groupBy("product_id").agg(F.count("*").alias("deleted"))
    matches = _matches(products, offers, stores)
    new_rows = dml.observation_rows(matches, moment)
    reports["per_product"] = ops.discovery_report(active, matches)
    return JobResult({"observations": dml.append_observations(base, new_rows)}, new_rows, reports)


def refresh(
    keys: DataFrame, products: DataFrame, offers: DataFrame, stores: DataFrame,
    observations: DataFrame, moment: str,
) -> JobResult:
    """Replace the scraped observations of the named active products with fresh ones."""
    from shelfprice.operators.catalog import by_id_or_slug

    chosen = by_id_or_slug(products.filter("is_active"), keys).drop("key").dropDuplicates(["product_id"])
    return discover(chosen, offers, stores, observations, moment, cleanup=True)


def seed_daily(
    products: DataFrame, offers: DataFrame, stores: DataFrame, observations: DataFrame, moment: str
) -> JobResult:
    """Append the cheapest result per store, except where the product was already seen there today."""
    # The search gives one row per product and store.
    best = _matches(products, offers, stores).select(
        "product_id", "store_id", "price", "currency", "url", "is_available", "package_size"
    )
    today = F.date_trunc("DAY", F.lit(moment).cast("timestamp_ntz"))
    seen = observations.filter(F.col("scraped_at") >= today).select(
        "product_id", "store_id", F.lit(True).alias("_seen")
    ).distinct()
    split = best.join(seen, ["product_id", "store_id"], "left")
    new_rows = dml.observation_rows(split.filter(F.col("_seen").isNull()).drop("_seen"), moment)
    report = split.agg(
        F.count_if(F.col("_seen").isNull()).alias("created"),
        F.count_if(F.col("_seen").isNotNull()).alias("skipped"),
    )
    return JobResult(
        {"observations": dml.append_observations(observations, new_rows)}, new_rows, {"totals": report}
    )


def rescrape(
    observations: DataFrame, products: DataFrame, stores: DataFrame, registered: DataFrame,
    details: DataFrame, started: str, finished: str,
    failures: DataFrame | None = None, page_rejects: DataFrame | None = None,
) -> JobResult:
    """Record the current price of every known URL in stores with a detail reader.

    `registered` lists store slugs. `details` holds the prices read from fresh captures: url, price, currency,
    is_available and, where a page may be captured twice, capture_id; the newest capture of a URL counts. `failures`
    (slug, error_message) names stores whose scrape broke off: what they gave until then stays, their run ends FAILED.
    `page_rejects` (url, broken_rule) says why pages gave no price.

    Reports: started (a RUNNING row per store), runs (how each ended), totals, missing (targets without a price and why).
    """
    scrapable = stores.filter("is_active").join(
        registered.select("slug"), "slug", "left_semi"
    ).select("store_id", "slug")
    targets = history.latest_with_url(
        observations.join(scrapable, "store_id", "left_semi"), products
    ).select("product_id", "store_id", "url")
    newest = [F.col(c).desc() for c in ("capture_id",) if c in details.columns] + [F.col("price").asc()]
    pages = first_per_group(details, ["url"], newest).select("url", "price", "currency", "is_available")
    fresh = targets.join(pages, "url")
    new_rows = dml.observation_rows(fresh, started)
    per_store = scrapable.join(new_rows.groupBy("store_id").agg(F.count("*").alias("_n")), "store_id", "left")
    if failures is None:
        per_store = per_store.withColumn("error_message", F.lit(None).cast("string"))
    else:
        errors = failures.groupBy("slug").agg(F.min("error_message").alias("error_message"))
        per_store = per_store.join(errors, "slug", "left")
    runs = dml.run_rows(
        per_store.select("store_id", F.coalesce("_n", F.lit(0)).alias("products_scraped"), "error_message"), started, finished
    )
    missing = targets.join(pages.select("url"), "url", "left_anti")
    if page_rejects is None:
        missing = missing.withColumn("reason", F.lit("no capture"))
    else:
        reasons = page_rejects.groupBy("url").agg(F.min("broken_rule").alias("_rule"))
        missing = missing.join(reasons, "url", "left").withColumn("reason", F.coalesce("_rule", F.lit("no capture"))).drop("_rule")
    missing = missing.unionByName(
        dml.observation_rejects(fresh).select("url", "product_id", "store_id", F.lit("price_range").alias("reason"))
    )
    return JobResult(
        {"observations": dml.append_observations(observations, new_rows)}, new_rows,
        {
            "started": dml.started_runs(scrapable, started), "runs": runs, "totals": ops.run_report(runs),
            "missing": missing.select("product_id", "store_id", "url", "reason"),
        },
    )


def track_from_search(
    requests: DataFrame, products: DataFrame, stores: DataFrame, observations: DataFrame,
    tracked: DataFrame, moment: str,
) -> JobResult:
    """Users follow products found in a search; prices of all stores in the request are kept.

    A request names its chosen result and siblings. An unknown chosen store rejects the request,
    unknown sibling stores are dropped.
    """
    valid, invalid = validate_track_requests(requests)
    known = stores.filter("is_active").select("store_id", F.col("slug").alias("store_slug"))
    accepted = valid.join(known.select("store_slug"), "store_slug", "left_semi").withColumn(
        "slug", slugify(F.col("name"))
    )
    rejected = valid.join(known.select("store_slug"), "store_slug", "left_anti")

    # A new product's identifier is a function of its slug, so the known ones are all that has to be looked up.
    known_ids = products.select("slug", F.col("product_id").alias("_known"))
    accepted = accepted.join(known_ids, "slug", "left").withColumn("product_id", F.coalesce("_known", F.xxhash64("slug")))
    fresh = accepted.filter(F.col("_known").isNull()).select(
        "product_id", "name", "slug", F.lit(None).cast("string").alias("description"), "image_url",
        F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("brand"),
        "ean", F.lit(True).alias("is_active"), "request_id",
    )
    new_products = first_per_group(fresh, ["slug"], [F.col("request_id").asc()]).select(*products.columns)

    names = [
        "store_slug", "price", "currency", "product_url", "package_size", "net_weight",
        "net_weight_unit", "subscribe_price",
    ]
    results = F.concat(
        F.array(F.struct(*names)), F.coalesce(F.col("siblings"), F.array())
    )
    rows = (
        accepted.select("request_id", "product_id", F.posexplode(results).alias("_no", "_row"))
        .select("request_id", "product_id", "_no", *[F.col(f"_row.{n}").alias(n) for n in names])
        .join(known, "store_slug")
        .withColumn("url", F.col("product_url"))
        .withColumn("observation_id", F.concat_ws("-", F.lit("track"), "request_id", "_no"))
    )
    new_rows = dml.observation_rows(rows, moment)
    follows = accepted.select(
        "user_id", "product_id", F.lit(moment).cast("timestamp_ntz").alias("created_at"), "request_id"
    )
    new_tracked = _missing(tracked, follows, ["user_id", "product_id"])
    return JobResult(
        {
            "products": products.unionByName(new_products), "tracked": tracked.unionByName(new_tracked),
            "observations": dml.append_observations(observations, new_rows),
        },
        new_rows,
        {"invalid": invalid, "unknown_store": rejected, "same_id": same_id(products, new_products)},
        {"products": new_products, "tracked": new_tracked, "observations": new_rows},
    )


def _missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The rows of new keys, the first request's of each, with the table's columns."""
    fresh = rows.join(table.select(*key), key, "left_anti")
    return first_per_group(fresh, key, [F.col("request_id").asc()]).select(*table.columns)


def same_id(products: DataFrame, new_products: DataFrame) -> DataFrame:
    """New products whose hashed identifier another slug has already, among the known or the new ones.

    To be checked before the tables are stored; with 64-bit hashes no row is expected.
    """
    all_ids = products.select("product_id", "slug").unionByName(new_products.select("product_id", "slug"))
    shared = all_ids.join(new_products.select("product_id").distinct(), "product_id", "left_semi").groupBy("product_id").agg(
        F.count("*").alias("products"), F.min("slug").alias("slug"), F.max("slug").alias("other_slug")
    )
    return shared.filter("products > 1")


def register_by_url(
    requests: DataFrame, products: DataFrame, stores: DataFrame, tracked: DataFrame,
    alerts: DataFrame, moment: str,
) -> JobResult:
    """Users add a product by its URL in a known store, with an optional target price."""
    target = F.col("target_price").cast("double")
    fits = F.col("target_price").try_cast("decimal(10,2)").isNotNull()
    known = stores.filter("is_active").select(F.col("slug").alias("store_slug"))
    sound = requests.filter(
        is_url(F.col("url")) & host(F.col("url")).isNotNull() & (target.isNull() | ((target > 0) & fits))
    ).join(known, "store_slug", "left_semi")
    keyed = sound.withColumns({
        "slug": F.sha2("url", 256), "product_id": F.xxhash64("url"), "name": host(F.col("url")),
    })
    fresh = keyed.select(
        "product_id", "name", "slug", F.col("url").alias("description"),
        *[F.lit(None).cast("string").alias(c) for c in ("image_url", "category", "brand", "ean")],
        F.lit(True).alias("is_active"), "request_id",
    )
    at = F.lit(moment).cast("timestamp_ntz")
    new_products = _missing(products, fresh, ["slug"])
    new_tracked = _missing(
        tracked, keyed.select("user_id", "product_id", at.alias("created_at"), "request_id"), ["user_id", "product_id"]
    )
    wanted = keyed.filter(F.col("target_price").isNotNull()).select(
        F.concat_ws("-", F.lit("url"), "request_id").alias("alert_id"), "user_id", "product_id",
        F.col("target_price").try_cast("decimal(10,2)").alias("target_price"),
        F.lit(True).alias("is_active"), F.lit(None).cast("timestamp_ntz").alias("triggered_at"),
        at.alias("created_at"),
    )
    new_alerts = wanted.join(alerts.select("alert_id"), "alert_id", "left_anti").select(*alerts.columns)
    return JobResult(
        {
            "products": products.unionByName(new_products), "tracked": tracked.unionByName(new_tracked),
            "alerts": alerts.unionByName(new_alerts),
        },
        new_products, {"same_id": same_id(products, new_products)},
        {"products": new_products, "tracked": new_tracked, "alerts": new_alerts},
    )
