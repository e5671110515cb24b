"""Keyed state of a progressive search: the best offer of every store, held per query."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfprice.functions import pricing
from shelfprice.functions.relevance import variant_conflict

#: What a row of the state and of the result holds besides its query and store; the first three decide which offer is best.
ORDER = ["conflict", "unit", "seq"]
PAYLOAD = ["product_name", "price", "subscribe_price", "package_size", "net_weight", "net_weight_unit", "product_url"]


def _precedence(offer: tuple) -> tuple:
    """Offers without a conflict first, then by price per pack item, those without one last, then by arrival and content."""
    conflict, unit, seq, name, price = offer[:5]
    return (conflict, unit is None, unit or 0.0, seq, price, name)


def keep_best(fields: list[T.StructField], keep_ms: int | None) -> Callable[..., Iterator[pd.DataFrame]]:
    """The update of one query. Its state holds one array for stores, one for the moments of writing and one for each field."""
    names = [f.name for f in fields]
    # pandas has NaN where Spark has null, and turns whole numbers with gaps into floats, which the state would not take.
    kinds = [int if isinstance(f.dataType, T.IntegralType) else float if isinstance(f.dataType, T.FractionalType) else lambda x: x for f in fields]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        moment = int(time.time() * 1000)
        known: dict[str, tuple] = {}
        if state.exists:
            stores, written, *values = state.get
            held = zip(stores, written, zip(*values, strict=True), strict=True)
            known = {s: (at, offer) for s, at, offer in held if keep_ms is None or moment - at <= keep_ms}
        changed = set()
        for frame in frames:
            for store, *values in frame[["store_slug", *names]].itertuples(index=False, name=None):
                offer = tuple(None if x is None or x != x else kind(x) for kind, x in zip(kinds, values, strict=True))
                if store not in known or _precedence(offer) < _precedence(known[store][1]):
                    known[store] = (moment, offer)
                    changed.add(store)
        if keep_ms is not None:
            state.setTimeoutDuration(max(1, max(at for at, _ in known.values()) + keep_ms - moment))
        if not changed:
            return
        stores = sorted(known)
        columns = [[known[s][1][i] for s in stores] for i in range(len(names))]
        state.update((stores, [known[s][0] for s in stores], *columns))
        yield pd.DataFrame({"query_id": key[0], "store_slug": stores, **dict(zip(names, columns, strict=True)), "changed": [s in changed for s in stores]}, dtype=object)

    return update


def reduced(relevant: DataFrame) -> DataFrame:
    """Rows of the state's columns, cut down to the best per query and store within each Arrow batch before they are shuffled.

    So a query that holds a large share of a micro-batch sends one row per store and batch to its task.
    """
    conflict = F.coalesce(variant_conflict(F.col("product_name"), F.col("query")), F.lit(False))
    rows = relevant.select("query_id", "store_slug", conflict.alias("conflict"), pricing.pack_unit_price().alias("unit"), "seq", *PAYLOAD)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ordered = batch.sort_values([*ORDER, "price", "product_name"], kind="stable", na_position="last")
            yield ordered.drop_duplicates(["query_id", "store_slug"])

    return rows.mapInPandas(first, rows.schema)


def best_offers(relevant: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """(query_id, store_slug, conflict, unit, seq, payload, changed) of every query that a micro-batch changed, from a stream of relevant offers.

    A changed query gives all of its stores, those whose best offer changed marked. A query without
    a change gives nothing. With keep_ms a store's offer is forgotten that long after it was written, and a query
    when all of its stores are.
    """
    rows = reduced(relevant)
    result = T.StructType([*rows.schema.fields, T.StructField("changed", T.BooleanType())])
    held = [f for f in rows.schema if f.name not in ("query_id", "store_slug")]
    state = T.StructType([
        T.StructField("store_slug", T.ArrayType(T.StringType())), T.StructField("written", T.ArrayType(T.LongType())),
        *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in held],
    ])
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("query_id").applyInPandasWithState(keep_best(held, keep_ms), result, state, "update", timeout)
