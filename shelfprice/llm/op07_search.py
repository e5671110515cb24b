"""Exact top-k search by inner product over vector-approximation blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import read_table, stored

#: Vectors of a block, bits of a cell number, exact vectors read at a time for one query.
BLOCK, CELL_BITS, READ = 4096, 6, 64
TOP = 20


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int, more: list[str] | None = None) -> DataFrame:
    """(id, dims, v, and the columns of more): floor(scale * x) of each component; leaves out null keys, null and empty vectors and those that hold nulls, NaN or infinities."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fit = F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.coalesce(fit, F.lit(False)) & (F.size(vector) > 0)).select(
        F.col(key).cast("long").alias("id"), F.size(vector).alias("dims"),
        F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"), *(more or []),
    )


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Pack rows into blocks of at most size vectors of equal length: dims, ids and components as little-endian 64-bit integers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, data = zip(*held.pop(dims), strict=True)
            return pa.record_batch(
                [pa.array([dims], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.concatenate(data).astype("<i8").tobytes()])],
                names=["dims", "ids", "data"],
            )

        for batch in batches:
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(1).to_numpy())
            for i, dims, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends.tolist(), strict=True):
                held.setdefault(dims, []).append((i, flat[end - dims:end]))
                if len(held[dims]) == size:
                    yield block(dims)
        for dims in list(held):
            yield block(dims)

    return rows.mapInArrow(pack, "dims int, ids binary, data binary")


def top_of_block(queries: tuple[np.ndarray, np.ndarray], points: tuple[np.ndarray, np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of the block's k best points, by upper bounds from quantised cells.

    Components become cell numbers between the block's least and greatest value of the dimension. A cell's edges bound
    the inner product from above. Exact vectors are read in the order of that bound until the kth score exceeds it.
    """
    qids, q = queries
    ids, x = points
    low, high = x.min(0), x.max(0)
    width = np.maximum(1, -(-(high - low + 1) // (1 << CELL_BITS)))
    cells = ((x - low) // width).astype(np.uint8)
    floor = low + cells * width
    # The greatest product of a component is at the cell's upper edge for positive, at the lower one for negative queries.
    bound = np.maximum(q, 0).astype(float) @ np.minimum(floor + width - 1, high).T.astype(float)
    bound += np.minimum(q, 0).astype(float) @ floor.T.astype(float)
    exact = x.astype(float)
    for row, qid in enumerate(qids.tolist()):
        upper = bound[row]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        want = min(len(upper), max(READ, 4 * k))
        order = np.argpartition(-upper, want - 1)[:want] if want < len(upper) else np.arange(len(upper))
        order = order[np.argsort(-upper[order], kind="stable")]
        done = 0
        while done < len(upper):
            if done == len(order):
                order = np.argsort(-upper, kind="stable")
                order = order[~np.isin(order, read)] if done else order
                order = np.concatenate([read, order])
            if len(best) >= k and upper[order[done]] < best[k - 1]:
                break
            part = order[done:done + READ]
            done += len(part)
            read = order[:done]
            part = part[ids[part] != qid]
            best_ids = np.concatenate([best_ids, ids[part]])
            best = np.concatenate([best, np.rint(exact[part] @ q[row].astype(float)).astype(np.int64)])
            keep = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[keep], best[keep]
        yield qid, best_ids, best


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """The k candidates of greatest integer inner product for each query row: query_id, rank, vec_id, score.

    Ties go to the smaller id. Rows with the query's own id are no candidates; an id that is a query in several rows
    is asked with each of them, and its best rows count. Each row is a candidate, repeated ones as often as they stand in
    the table, however it is cut into files. Vectors meet only those of equal length. Scores are exact while
    they stay below 2**53. Vectors with nulls or non-finite components and null ids take no part.

    Points and queries are packed into blocks, each pair of a query and a point block is one group of two rows, and
    each group returns k rows for a query, so no group grows with the data; the last merge keeps k rows per query.
    """
    rows = integer_vectors(vectors.withColumn("is_query", F.coalesce(is_query, F.lit(False))), key, vector, scale)
    asked = integer_vectors(vectors.filter(is_query), key, vector, scale)
    # Numbers, not hashes, name the blocks, as blocks of repeated rows may be equal; stored, so they stay.
    point_blocks = stored(blocks(rows, BLOCK).withColumn("block", F.monotonically_increasing_id()))
    query_blocks = stored(blocks(asked.repartition(F.floor(F.col("id") / F.lit(1 << 16))), BLOCK).withColumn("block", F.monotonically_increasing_id()))
    # Each point block is sent to every query block of its length, and the other way round: the work asked for, in blocks.
    p_names, q_names = (b.select("dims", "block") for b in (point_blocks, query_blocks))
    pairs = p_names.withColumnRenamed("block", "p").join(q_names.withColumnRenamed("block", "q"), "dims").distinct()
    sides = [
        pairs.select("dims", "p", "q", F.col(own).alias("block")).join(b, ["dims", "block"]).select("p", "q", F.lit(own).alias("side"), "dims", "ids", "data")
        for own, b in (("p", point_blocks), ("q", query_blocks))
    ]

    def search(group: pd.DataFrame) -> pd.DataFrame:
        both = {side: group[group.side == side].iloc[0] for side in ("p", "q")}
        points, queries = (
            (np.frombuffer(b.ids, "<i8"), np.frombuffer(b["data"], "<i8").reshape(-1, b.dims)) for b in (both["p"], both["q"])
        )
        found = [(q, i, s) for q, i, s in top_of_block(queries, points, k) if len(i)]
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.DataFrame({
            "query_id": np.repeat([q for q, _, _ in found], [len(i) for _, i, _ in found]),
            "vec_id": np.concatenate([i for _, i, _ in found]), "score": np.concatenate([s for _, _, s in found]),
        })

    best = sides[0].union(sides[1]).groupBy("p", "q").applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
