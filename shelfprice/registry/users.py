"""Views for users."""

from pyspark.sql import functions as F

from shelfprice.adapter import tables as t
from shelfprice.adapter.oracle import EFFECTIVE, with_ctes
from shelfprice.operators import users

MOMENT = "2026-01-01 06:00:00"


def best_tracked_offer(spark, d):
    return users.best_current_offer(t.observations(spark, d), t.stores(spark, d))


def tracked_overview(spark, d):
    rows = users.tracked_overview(
        t.tracked(spark, d), t.products(spark, d), t.observations(spark, d), t.stores(spark, d)
    )
    return rows.select("user_id", "product_id", "name", "created_at", "stores", "best_price", "best_store")


def tracked_lowest_recent(spark, d):
    rows = users.tracked_products(t.tracked(spark, d), t.products(spark, d), t.observations(spark, d))
    return rows.select(
        "user_id", "product_id", "lowest_price", "lowest_observation_id",
        *[F.get("recent", F.lit(i))["observation_id"].alias(f"recent_{i + 1}") for i in range(3)],
    )


def dashboard_counts(spark, d):
    return users.dashboard_counts(t.tracked(spark, d), t.alerts(spark, d))


def recent_for_users(spark, d):
    rows = users.recent_for_users(
        t.tracked(spark, d), t.observations(spark, d), t.products(spark, d), t.stores(spark, d)
    )
    return rows.select("user_id", "observation_id", "product_name", "store_name", "price", "scraped_at")


def alerts_view(spark, d):
    rows = users.alerts_view(t.alerts(spark, d), t.products(spark, d))
    return rows.select("alert_id", "user_id", "product_name", "product_slug", "target_price", "is_active", "created_at")


def alerts_triggered(spark, d):
    rows = users.evaluate_alerts(t.alerts(spark, d), t.observations(spark, d), MOMENT)
    return rows.select("alert_id", "product_id", "target_price", "current_price", "triggered_at")


QUERIES = {
    f.__name__: f
    for f in [
        best_tracked_offer, tracked_overview, tracked_lowest_recent, dashboard_counts, recent_for_users,
        alerts_view, alerts_triggered,
    ]
}

_BEST = f"""SELECT product_id, count(*) OVER (PARTITION BY product_id) AS stores, eff AS best_price, name AS best_store
  FROM (SELECT l.*, s.name, {EFFECTIVE} AS eff FROM latest l LEFT JOIN stores s USING (store_id))
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY eff, store_id, observation_id) = 1"""

SQL = {
    "best_tracked_offer": with_ctes(_BEST, "latest", "stores"),
    "tracked_overview": with_ctes(f"""
      SELECT user_id, product_id, name, created_at, coalesce(stores, 0) AS stores, best_price, best_store
      FROM tracked JOIN products USING (product_id) LEFT JOIN ({_BEST}) USING (product_id)""",
        "tracked", "products", "latest", "stores"),
    "tracked_lowest_recent": with_ctes("""
      SELECT user_id, product_id, lowest_price, lowest_observation_id, recent_1, recent_2, recent_3
      FROM tracked LEFT JOIN (
        SELECT product_id, min(price) AS lowest_price,
          first(observation_id ORDER BY price, recency) AS lowest_observation_id,
          max(observation_id) FILTER (recency = 1) AS recent_1, max(observation_id) FILTER (recency = 2) AS recent_2,
          max(observation_id) FILTER (recency = 3) AS recent_3
        FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY scraped_at DESC, observation_id DESC)
          AS recency FROM observations) WHERE recency <= 10 GROUP BY product_id) USING (product_id)""",
        "tracked", "observations"),
    "dashboard_counts": with_ctes("""
      SELECT user_id, coalesce(t.n, 0) AS tracked, coalesce(a.n, 0) AS active_alerts
      FROM (SELECT user_id, count(*) AS n FROM tracked GROUP BY 1) t
      FULL JOIN (SELECT user_id, count(*) AS n FROM alerts WHERE is_active GROUP BY 1) a USING (user_id)""",
        "alerts"),
    "recent_for_users": with_ctes("""
      SELECT user_id, observation_id, product_name, store_name, price, scraped_at FROM (
        SELECT user_id, observation_id, p.name AS product_name, s.name AS store_name, price, scraped_at,
          row_number() OVER (PARTITION BY user_id ORDER BY scraped_at DESC, observation_id DESC) AS rn
        FROM tracked JOIN observations USING (product_id) JOIN products p USING (product_id)
          JOIN stores s USING (store_id)) WHERE rn <= 5""", "tracked", "observations", "products", "stores"),
    "alerts_view": with_ctes("""
      SELECT alert_id, user_id, p.name AS product_name, p.slug AS product_slug, target_price, a.is_active, created_at
      FROM alerts a JOIN products p USING (product_id)""", "alerts", "products"),
    "alerts_triggered": with_ctes(f"""
      SELECT alert_id, product_id, target_price, current_price, TIMESTAMP '{MOMENT}' AS triggered_at
      FROM alerts JOIN (SELECT product_id, min({EFFECTIVE}) AS current_price FROM latest GROUP BY 1)
        USING (product_id)
      WHERE is_active AND triggered_at IS NULL AND current_price <= CAST(target_price AS DOUBLE)""",
        "alerts", "latest"),
}
