"""Views kept up to date by daily deltas, equal to the views made anew."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import with_ctes
from shelfprice.operators import dml, maintained
from shelfprice.streaming.runs import work_dir

#: Daily deltas that the observations arrive in.
DAYS = 10
#: Parts of a state that a merge takes at once.
MOST_PARTS = 16
_LATEST = ["observation_id", "product_id", "store_id", "price", "scraped_at"]


def _deltas(spark, d):
    """The observations dealt by day into deltas, out of order of time."""
    rows = t.observations(spark, d)
    return [rows.filter(F.pmod(F.datediff("scraped_at", F.lit("1992-01-01")), F.lit(DAYS)) == k) for k in range(DAYS)]


def _kept(spark, first, merge, deltas, name):
    """The state after the last delta. Each day stores a part of its own, and no day reads what the days before it stored;
    once there are MOST_PARTS, the next day merges them into one."""
    path = work_dir(spark, name)
    parts = []
    for k, delta in enumerate(deltas[:-1]):
        full = len(parts) == MOST_PARTS
        day = merge(_parts(spark, parts, schema), delta) if full else first(delta)
        day.write.parquet(f"{path}/day={k}")
        schema = day.schema
        parts = [*([] if full else parts), f"{path}/day={k}"]
    return merge(_parts(spark, parts, schema), deltas[-1])


def _parts(spark, parts, schema):
    return spark.read.schema(schema).parquet(*parts)


def _pairs(spark, d):
    return _kept(spark, maintained.pair_state, maintained.merge_pairs, _deltas(spark, d), "pairs")


def maintained_latest(spark, d):
    return maintained.latest_of(_pairs(spark, d), available_only=True).select(*_LATEST)


def maintained_counts(spark, d):
    return maintained.counts_of(_pairs(spark, d))


def maintained_recent(spark, d):
    state = _kept(
        spark, lambda rows: maintained.recent_state(rows, 5), lambda state, rows: maintained.merge_recent(state, rows, 5), _deltas(spark, d), "recent"
    )
    return state.select("observation_id", "product_id", "recency")


def maintained_after_cleanup(spark, d):
    """The newest available rows after the scraped rows of the inactive products went."""
    state = _pairs(spark, d)
    left, deleted = dml.delete_scraped(t.observations(spark, d), t.products(spark, d).filter(~F.col("is_active")))
    return maintained.latest_of(maintained.retract_pairs(state, deleted, left), available_only=True).select(*_LATEST)


QUERIES = {f.__name__: f for f in [maintained_latest, maintained_counts, maintained_recent, maintained_after_cleanup]}

_NEWEST = """SELECT observation_id, product_id, store_id, price, scraped_at FROM {rows}
  QUALIFY row_number() OVER (PARTITION BY product_id, store_id ORDER BY scraped_at DESC, observation_id DESC) = 1"""

SQL = {
    "maintained_latest": with_ctes(_NEWEST.format(rows="observations WHERE is_available"), "observations"),
    "maintained_counts": with_ctes("SELECT product_id, count(*) AS observations FROM observations GROUP BY 1", "observations"),
    "maintained_recent": with_ctes("""
      SELECT observation_id, product_id, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, observation_id DESC) AS recency
      FROM observations QUALIFY recency <= 5""", "observations"),
    "maintained_after_cleanup": with_ctes(_NEWEST.format(rows="""observations WHERE is_available AND NOT (source = 'SCRAPE'
      AND product_id IN (SELECT product_id FROM products WHERE NOT is_active))"""), "observations", "products"),
}
