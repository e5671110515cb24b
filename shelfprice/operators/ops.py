"""Store status and job reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfprice.functions import labels
from shelfprice.operators.groups import first_per_group


def latest_run(runs: DataFrame) -> DataFrame:
    return first_per_group(runs, ["store_id"], [F.col("started_at").desc(), F.col("run_id").desc()])


def store_status(stores: DataFrame, runs: DataFrame) -> DataFrame:
    """Active stores with their latest run; NEVER where there is none."""
    last = latest_run(runs).select(
        "store_id", "run_id", "started_at", "finished_at", "status", "products_scraped", "error_message"
    )
    joined = stores.filter("is_active").join(last, "store_id", "left")
    status = F.coalesce("status", F.lit("NEVER"))
    return joined.withColumns({
        "status": status,
        "status_label": labels.status_label(status),
        "type_label": labels.store_type_label(F.col("type")),
    })


def status_summary(status: DataFrame) -> DataFrame:
    """Stores whose latest run succeeded or failed, and stores never run; running ones are in none."""
    return status.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("success"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(F.col("status") == "NEVER").alias("never"),
    )


def run_report(runs: DataFrame) -> DataFrame:
    """Totals of a set of finished runs."""
    return runs.agg(
        F.coalesce(F.sum("products_scraped"), F.lit(0)).alias("scraped"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count("*").alias("stores"),
    )


def discovery_report(products: DataFrame, discovered: DataFrame) -> DataFrame:
    """Per searched product: number of new observations and the store names in rank order."""
    found = discovered.groupBy("product_id").agg(
        F.count("*").alias("discovered"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "store_name"))), lambda s: s["store_name"]
        ).alias("stores"),
    )
    return products.select("product_id", "slug").join(found, "product_id", "left").select(
        "product_id", F.col("slug").alias("product_slug"),
        F.coalesce("discovered", F.lit(0)).alias("discovered"),
        F.coalesce("stores", F.array().cast("array<string>")).alias("stores"),
    )


def coverage_report(valid: DataFrame, queries: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """Quantity coverage of the valid offers per store; with stores, those without an offer have zeros and no percentages."""
    per_query = valid.groupBy("store_slug", "query_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("package_size").isNotNull()).alias("sized"),
        F.count_if(F.col("net_weight").isNotNull()).alias("weighed"),
    )
    report = per_query.groupBy("store_slug").agg(
        F.count("*").alias("queries_with_results"), F.sum("n").alias("valid_results"),
        F.sum("sized").alias("with_package_size"), F.sum("weighed").alias("with_net_weight"),
    )

    if stores is not None:
        counts = ["queries_with_results", "valid_results", "with_package_size", "with_net_weight"]
        report = stores.select(F.col("slug").alias("store_slug")).join(report, "store_slug", "left").fillna(0, counts)

    def share(part: str):
        return F.floor(F.try_divide(F.col(part), F.col("valid_results")) * 100 + 0.5).cast("int")

    return report.withColumns({
        "queries": queries.agg(F.count("*")).scalar(),
        "package_size_percent": share("with_package_size"),
        "net_weight_percent": share("with_net_weight"),
    })


def missing_quantity_names(valid: DataFrame, n: int = 5) -> DataFrame:
    """First few titles per store and query that gave neither size nor weight."""
    rows = valid.filter(F.col("package_size").isNull() & F.col("net_weight").isNull())
    return first_per_group(
        rows.select("store_slug", "query_id", "seq", "product_name"),
        ["store_slug", "query_id"], [F.col("seq").asc()], n,
    )


def scraper_health(outcomes: DataFrame) -> DataFrame:
    """Class of each probe: results, empty (page loads, nothing found) or blocked."""
    health = (
        F.when(F.col("results") > 0, "passed").when(F.col("http_status") == "200", "empty").otherwise("blocked")
    )
    return outcomes.withColumn("health", health)


def health_summary(outcomes: DataFrame) -> DataFrame:
    return scraper_health(outcomes).groupBy("health").agg(F.count("*").alias("stores"))
