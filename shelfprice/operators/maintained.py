"""Views of the price history kept up to date: small states that a day's observations are merged into.

A state is a table of its own. What a view needs of the history is read off its state, and a day's rows change it without the
history being read again. Each state is the same whatever the days it was merged from and their order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.operators.history import newest_first

_PAIR = ["product_id", "store_id"]


def _newest(row: Column, order: Column, which: Column) -> Column:
    return F.max_by(F.when(which, row), F.when(which, order))


def pair_state(observations: DataFrame) -> DataFrame:
    """(product_id, store_id, newest_available, newest_other, observations): the newest available row of each pair, the newest of its others
    and the number of its rows. No row is held twice."""
    order = F.struct("scraped_at", "observation_id")
    row = F.struct(*observations.columns)
    free = F.coalesce("is_available", F.lit(False))
    return observations.groupBy(*_PAIR).agg(
        _newest(row, order, free).alias("newest_available"), _newest(row, order, ~free).alias("newest_other"),
        F.count("*").alias("observations"),
    )


def _order(side: str) -> Column:
    return F.struct(F.col(f"{side}.scraped_at"), F.col(f"{side}.observation_id"))


def merge_pairs(state: DataFrame, added: DataFrame) -> DataFrame:
    """The state with the given observations added; they must not be among those it was made of.

    The state may be the rows of several states of different observations: a pair that stands in many of them is settled here.
    """
    both = state.unionByName(pair_state(added.select(*state.schema["newest_available"].dataType.fieldNames())))
    return both.groupBy(*_PAIR).agg(
        *[_newest(F.col(side), _order(side), F.col(side).isNotNull()).alias(side) for side in ("newest_available", "newest_other")],
        F.sum("observations").alias("observations"),
    )


def retract_pairs(state: DataFrame, deleted: DataFrame, left: DataFrame) -> DataFrame:
    """The state after observations were deleted; left are those that stay, of all pairs or only of the pairs that lost one.

    Only pairs that lost rows are made anew, from what is left of them.
    """
    lost = deleted.select(*_PAIR).distinct()
    names = state.schema["newest_available"].dataType.fieldNames()
    return state.join(lost, _PAIR, "left_anti").unionByName(pair_state(left.select(*names).join(lost, _PAIR, "left_semi")))


def latest_of(state: DataFrame, available_only: bool = False) -> DataFrame:
    """latest_per_product_store of the observations that a state was made of."""
    free, other = F.col("newest_available"), F.col("newest_other")
    newest = F.when(other.isNull() | (free.isNotNull() & (_order("newest_available") >= _order("newest_other"))), free).otherwise(other)
    held = state.select((free if available_only else newest).alias("held"))
    return held.filter(F.col("held").isNotNull()).select("held.*")


def counts_of(state: DataFrame) -> DataFrame:
    """Number of observations per product."""
    return state.groupBy("product_id").agg(F.sum("observations").alias("observations"))


def recent_state(observations: DataFrame, n: int) -> DataFrame:
    """The newest n observations of each product, numbered."""
    window = Window.partitionBy("product_id").orderBy(*newest_first())
    return observations.withColumn("recency", F.row_number().over(window)).filter(F.col("recency") <= n)


def merge_recent(state: DataFrame, added: DataFrame, n: int) -> DataFrame:
    """The state with observations added; it may be the rows of several states."""
    return recent_state(state.drop("recency").unionByName(added.select(*state.drop("recency").columns)), n)


def retract_recent(state: DataFrame, deleted: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """The state after a deletion: products that lost one of their newest n rows get theirs from what is left of them."""
    lost = state.select("product_id", "observation_id").join(deleted.select("product_id", "observation_id"), ["product_id", "observation_id"], "left_semi")
    lost = lost.select("product_id").distinct()
    again = left.select(*state.drop("recency").columns).join(lost, "product_id", "left_semi")
    return state.join(lost, "product_id", "left_anti").unionByName(recent_state(again, n).select(*state.columns))


def differing(kept: DataFrame, anew: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that a maintained view and the view made anew don't share, for checks."""
    return kept.select(*columns).exceptAll(anew.select(*columns)).unionByName(anew.select(*columns).exceptAll(kept.select(*columns)))
