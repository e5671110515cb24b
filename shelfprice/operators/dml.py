"""Table maintenance: every operator takes tables and gives the changed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.operators.groups import first_per_group
from shelfprice.schemas import OBSERVATIONS


def observation_rows(matches: DataFrame, moment: str, source: str = "SCRAPE") -> DataFrame:
    """Observation rows from matches; fields a match does not have become null.

    The identifier is derived from the content, so a re-run of the job gives the same rows. Matches whose price does not
    fit the column are left out (see observation_rejects); other amounts that don't fit become null.
    """
    defaults = {
        "currency": F.lit("EUR"), "source": F.lit(source), "is_available": F.lit(True),
        "scraped_at": F.lit(moment).cast("timestamp_ntz"),
        "observation_id": F.sha2(
            F.concat_ws("|", "product_id", "store_id", F.lit(moment), F.lit(source)), 256
        ),
    }

    def column(field) -> Column:
        default = defaults.get(field.name, F.lit(None))
        if field.name in matches.columns and field.name not in ("source", "scraped_at"):
            return F.coalesce(F.col(field.name), default).try_cast(field.dataType).alias(field.name)
        return default.cast(field.dataType).alias(field.name)

    return matches.filter(_price_fits()).select(*[column(f) for f in OBSERVATIONS])


def _price_fits() -> Column:
    return F.col("price").isNull() | F.col("price").try_cast(OBSERVATIONS["price"].dataType).isNotNull()


def observation_rejects(matches: DataFrame) -> DataFrame:
    """Matches that observation_rows leaves out, with the broken rule."""
    return matches.filter(~_price_fits()).withColumn("broken_rules", F.array(F.lit("price_range")))


def append_observations(observations: DataFrame, new_rows: DataFrame) -> DataFrame:
    if "scrape_date" in observations.columns:
        new_rows = new_rows.withColumn("scrape_date", F.to_date("scraped_at"))
    return observations.unionByName(new_rows.select(*observations.columns))


def upsert_missing(
    table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Insert rows whose key is new; existing rows stay as they are, the first of equal new keys wins."""
    fresh = first_per_group(rows.join(table.select(*key), list(key), "left_anti"), key, order)
    return table.unionByName(fresh.select(*table.columns))


def delete_scraped(observations: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove scraped observations of the given products, entered ones stay. Gives (kept, deleted)."""
    scraped = observations.filter(F.col("source") == "SCRAPE")
    others = observations.filter(F.coalesce(F.col("source") != "SCRAPE", F.lit(True)))
    keys = products.select("product_id").distinct()
    kept = others.unionByName(scraped.join(keys, "product_id", "left_anti"))
    return kept, scraped.join(keys, "product_id", "left_semi")


def delete_cascade(tables: dict[str, DataFrame], products: DataFrame) -> dict[str, DataFrame]:
    """Remove products with their observations, followers and alerts."""
    keys = products.select("product_id").distinct()
    return {
        name: table.join(keys, "product_id", "left_anti")
        if name in ("products", "observations", "tracked", "alerts") else table
        for name, table in tables.items()
    }


def settled(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """The first row of every key, and the rows that come after it.

    Rows that the order leaves equal are put in order by their columns, so only equal rows are left to chance. The later rows are all
    rows less the first ones, each as often as it stands there; no key's rows come together in one task.
    """
    first = first_per_group(rows, keys, [*order, *(F.col(c).asc_nulls_last() for c in rows.columns)])
    return first, rows.exceptAll(first)


def partial_update(
    table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str], owner: str | None = None,
    order: Sequence[Column] = (),
) -> tuple[DataFrame, DataFrame]:
    """Overwrite the named columns where a change gives a value.

    With owner, a change only applies to a row of the same owner. Of several changes of one key the first in the given
    order counts. Gives (table, rejected changes): those of unknown keys and those that came second.
    """
    keys = [key, owner] if owner else [key]
    first, later = settled(changes, keys, order or [F.col(c).asc_nulls_last() for c in columns])
    feed = first.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    updated = table.join(feed, keys, "left").select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )
    unknown = first.join(table.select(*keys), keys, "left_anti").select(*changes.columns)
    return updated, unknown.unionByName(later)


def delete_by_key(table: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return table.join(keys.select(*key), list(key), "left_anti")


def insert_unique(
    table: DataFrame, rows: DataFrame, key: Sequence[str], order: Sequence[Column]
) -> tuple[DataFrame, DataFrame]:
    """Insert validated rows; a key that exists, or that an earlier new row has, is a conflict. Gives (table, conflicts)."""
    first, later = settled(rows, key, order)
    merged = table.unionByName(first.join(table.select(*key), list(key), "left_anti").select(*table.columns))
    return merged, first.join(table.select(*key), list(key), "left_semi").select(*rows.columns).unionByName(later)


def upsert_columns(
    table: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], order: Sequence[Column] = ()
) -> DataFrame:
    """Insert new keys whole; for existing keys take only the listed columns (nulls included).

    Of several rows of one key the first in the given order counts; settled() names the others.
    """
    first = first_per_group(rows, [key], order or [F.col(c).asc_nulls_last() for c in table.columns if c != key])
    feed = first.select(
        F.col(key), F.lit(True).alias("_hit"),
        *[F.col(c).alias(f"_new_{c}") for c in table.columns if c != key],
    )
    joined = table.withColumn("_old", F.lit(True)).join(feed, key, "full")

    def column(name: str) -> Column:
        if name == key:
            return F.col(key)
        fresh = F.col("_old").isNull()
        if name in columns:
            fresh = fresh | F.col("_hit").isNotNull()
        return F.when(fresh, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(*[column(c) for c in table.columns])


def started_runs(stores: DataFrame, started: str) -> DataFrame:
    """Run log rows at the start of a job: RUNNING, nothing scraped yet."""
    return stores.select(
        "store_id", F.lit(started).cast("timestamp_ntz").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"), F.lit("RUNNING").alias("status"),
        F.lit(0).alias("products_scraped"), F.lit(None).cast("string").alias("error_message"),
    )


def run_rows(results: DataFrame, started: str, finished: str) -> DataFrame:
    """Run log of a job: SUCCESS, or FAILED where an error text is given."""
    failed = F.col("error_message").isNotNull()
    return results.select(
        "store_id", F.lit(started).cast("timestamp_ntz").alias("started_at"),
        F.lit(finished).cast("timestamp_ntz").alias("finished_at"),
        F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
        F.col("products_scraped").cast("int").alias("products_scraped"), "error_message",
    )
