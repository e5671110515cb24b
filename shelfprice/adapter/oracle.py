"""The derivations of tables.py as SQL common table expressions."""

from __future__ import annotations

_PRICE = "floor(l_extendedprice / l_quantity * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE"

CTES = {
    "stores": """
      SELECT s_suppkey AS store_id, s_name AS name,
        lower(replace(s_name, '#', '-')) AS slug,
        CASE s_nationkey % 3 WHEN 0 THEN 'ONLINE' WHEN 1 THEN 'PHYSICAL' ELSE 'BOTH' END AS type,
        'https://' || lower(replace(s_name, '#', '-')) || '.example' AS website_url,
        s_acctbal >= 0 AS is_active,
        CASE WHEN s_nationkey % 4 <> 0 THEN CAST(10 * (s_nationkey % 6 + 1) AS DECIMAL(10,2)) END
          AS free_shipping_threshold,
        CASE WHEN s_nationkey % 5 <> 0 THEN 'Envío 24/48 h' END AS shipping_note
      FROM supplier""",
    "products": """
      SELECT p_partkey AS product_id, p_brand || ' ' || p_name AS name,
        lower(replace(replace(p_brand || ' ' || p_name, '#', '-'), ' ', '-')) || '-' || p_partkey AS slug,
        p_type AS category, p_brand AS brand, lpad(CAST(p_partkey AS VARCHAR), 13, '0') AS ean,
        p_size <> 50 AS is_active
      FROM part""",
    "observations": f"""
      SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS observation_id,
        l_partkey AS product_id, l_suppkey AS store_id,
        CAST({_PRICE} AS DECIMAL(10,2)) AS price, 'EUR' AS currency,
        CASE WHEN l_linenumber <> 7 THEN 'https://shop.example/' || l_suppkey || '/' || l_partkey END AS url,
        CASE l_linenumber % 4 WHEN 0 THEN 'MANUAL' WHEN 1 THEN 'API' ELSE 'SCRAPE' END AS source,
        l_returnflag <> 'R' AS is_available,
        CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_quantity AS INTEGER) END AS package_size,
        CASE WHEN l_partkey % 3 <> 2 THEN CAST((l_partkey % 50 + 1) * 10 AS DECIMAL(10,2)) END AS net_weight,
        CASE l_partkey % 3 WHEN 0 THEN 'g' WHEN 1 THEN 'ml' END AS net_weight_unit,
        CASE WHEN l_discount > 0.05::DOUBLE THEN CAST(floor(({_PRICE}) * (1 - l_discount) * 100.0::DOUBLE
          + 0.5::DOUBLE) / 100.0::DOUBLE AS DECIMAL(10,2)) END AS subscribe_price,
        CASE WHEN l_tax <= 0.06::DOUBLE THEN CAST(floor(l_tax * 100.0::DOUBLE * 100.0::DOUBLE + 0.5::DOUBLE)
          / 100.0::DOUBLE AS DECIMAL(10,2)) END AS shipping_cost,
        l_shipdate AS scraped_at
      FROM lineitem""",
    "tracked": """
      SELECT o_custkey AS user_id, l_partkey AS product_id, min(o_orderdate) AS created_at
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "alerts": """
      SELECT user_id || '-' || product_id AS alert_id, user_id, product_id,
        CAST(500 + (user_id * 31 + product_id) % 3000 AS DECIMAL(10,2)) AS target_price,
        (user_id + product_id) % 5 <> 0 AS is_active, CAST(NULL AS TIMESTAMP) AS triggered_at, created_at
      FROM tracked""",
    "runs": """
      SELECT o_orderkey AS run_id, o_custkey AS store_id, o_orderdate AS started_at,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS finished_at,
        CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status,
        CAST(o_orderkey % 50 AS INTEGER) AS products_scraped,
        CASE WHEN o_orderstatus = 'O' THEN 'HTTP 503' END AS error_message
      FROM orders""",
    "queries": "SELECT p_partkey AS query_id, p_brand || ' ' || p_name AS query FROM part",
    "offers": f"""
      SELECT l_partkey AS query_id,
        lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber || '-' ||
          lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS seq,
        'supplier-' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS store_slug,
        'Supplier ' || l_suppkey AS store_name,
        CASE l_linenumber WHEN 1 THEN p_brand || ' ' || p_name || ' 6x33cl'
          WHEN 2 THEN p_brand || ' ' || p_name || ' con gas 1,5 L'
          WHEN 3 THEN upper(p_brand || ' ' || p_name) || ' sin gas'
          WHEN 4 THEN p_name WHEN 5 THEN 'Pack ' || p_brand || ' ' || p_name
          WHEN 6 THEN p_brand || ' surtido' ELSE p_brand || ' ' || p_name || ' sparkling' END AS product_name,
        CASE WHEN l_quantity = 50 THEN 0.0::DOUBLE ELSE {_PRICE} END AS price,
        CASE WHEN l_discount > 0.05::DOUBLE THEN floor(({_PRICE}) * (1 - l_discount) * 100.0::DOUBLE
          + 0.5::DOUBLE) / 100.0::DOUBLE END AS subscribe_price,
        'EUR' AS currency, 'https://shop.example/' || l_suppkey || '/' || l_partkey AS product_url,
        l_returnflag <> 'R' AS is_available,
        CASE WHEN l_linenumber % 5 <> 0 THEN CAST(l_quantity AS INTEGER) END AS package_size,
        CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 50 + 1) * 10.0::DOUBLE END AS net_weight,
        CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_partkey % 3 = 0 THEN 'g' ELSE 'ml' END END
          AS net_weight_unit,
        CASE WHEN l_linenumber = 6 AND l_returnflag = 'N' THEN lpad(CAST(l_partkey AS VARCHAR), 13, '0') END
          AS ean
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    # Offers that survive validation and relevance. Every title of the offers is made from the brand
    # and name, so the rule comes down to: the brand number stands alone, and the words are there.
    "relevant": r"""
      SELECT o.*, q.query,
        regexp_matches(lower(product_name), 'con gas|carbonatada|carbonatado|con burbujas|sparkling') AS conflict,
        coalesce(subscribe_price, price) / coalesce(package_size, 1) AS pack_unit
      FROM offers o JOIN queries q USING (query_id)
      WHERE price > 0 AND (ean IS NOT NULL OR (
        regexp_matches(lower(product_name), '(^|[^0-9-])t?' || regexp_extract(query, '[0-9]+') || '([^0-9-]|$)')
        AND len(list_filter(string_split(regexp_replace(lower(query), '[^a-z]+', ' ', 'g'), ' '),
                            lambda w: len(w) >= 2 AND contains(lower(product_name), w)))
          >= 0.8 * len(list_filter(string_split(regexp_replace(lower(query), '[^a-z]+', ' ', 'g'), ' '),
                                   lambda w: len(w) >= 2))))""",
    "searched": """
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, store_slug ORDER BY pack_unit, seq) AS store_rank
        FROM (SELECT *, bool_or(NOT conflict) OVER (PARTITION BY query_id) AS any_clean FROM relevant)
        WHERE NOT (conflict AND any_clean)) WHERE store_rank = 1""",
    "latest": """
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id
        ORDER BY scraped_at DESC, observation_id DESC) AS rn FROM observations WHERE is_available) WHERE rn = 1""",
}

_NEEDS = {
    "alerts": ["tracked"], "relevant": ["queries", "offers"], "searched": ["relevant"],
    "latest": ["observations"],
}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """SQL of a query body over the named model tables."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def votes(rows: str, group: str) -> str:
    """Comparison mode per group over a relation."""
    return f"""
      SELECT {group}, CASE WHEN greatest(g, ml, u) = 0 THEN 'rawPrice' WHEN g = greatest(g, ml, u) THEN 'per100g'
          WHEN ml = greatest(g, ml, u) THEN 'per100ml' ELSE 'perUnit' END AS mode,
        g AS votes_g, ml AS votes_ml, u AS votes_unit
      FROM (SELECT {group}, count(*) FILTER (net_weight_unit = 'g') AS g,
          count(*) FILTER (net_weight_unit = 'ml') AS ml,
          count(*) FILTER (net_weight_unit IS NULL AND package_size IS NOT NULL) AS u
        FROM {rows} GROUP BY ALL)"""


def comparable(base: str) -> str:
    """Comparable price of a row whose mode and effective price are given."""
    return f"""CASE WHEN mode IN ('per100g', 'per100ml') THEN CASE WHEN net_weight > 0 THEN
        {base} / (CAST(coalesce(package_size, 1) AS DOUBLE) * CAST(net_weight AS DOUBLE)) * 1000.0::DOUBLE END
      WHEN mode = 'perUnit' THEN {base} / CAST(package_size AS DOUBLE) WHEN mode = 'rawPrice' THEN {base} END"""


EFFECTIVE = "CAST(coalesce(subscribe_price, price) AS DOUBLE)"
WITH_SHIPPING = f"({EFFECTIVE} + coalesce(CAST(shipping_cost AS DOUBLE), 0.0::DOUBLE))"
