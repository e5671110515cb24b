"""Hard-negative mining: scores along a spanning tree of anchors bound each other, only rows that may reach a window are scored."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import read_table, stored
from shelfprice.llm.op07_search import integer_vectors

POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive score between which a negative's score has to lie.
LOW_PERCENT, HIGH_PERCENT = 30, 90
#: Bytes of anchor vectors that one pass sends to the tasks, and rows that a task scores at a time.
PASS_BYTES, BLOCK = 4 << 20, 4096
#: Whole numbers up to here are exact in double precision.
EXACT = 1 << 53


def comparable(rows: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where all their products are sure to be exact in them, which is much faster, else as they are."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    return (rows.astype(float), vectors.astype(float)) if most < EXACT else (rows, vectors)


@dataclass
class Tree:
    """Anchors of equal length in the order in which a spanning tree reaches them; parent is a place in that order, -1 for the root."""

    names: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(names: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tree:
    """Least spanning tree by Prim's method, from the first anchor on; edge is the length of the edge to the parent, rounded up."""
    n = len(ids)
    x = vectors.astype(float)
    squares = (x * x).sum(1)
    order, parent = np.zeros(n, np.int64), np.full(n, -1)
    place = np.zeros(n, np.int64)
    near, via = np.full(n, np.inf), np.full(n, -1)
    near[0] = 0
    out = np.zeros(n, bool)
    for k in range(n):
        node = int(np.argmin(np.where(out, np.inf, near)))
        order[k], out[node], place[node] = node, True, k
        parent[k] = place[via[node]] if via[node] >= 0 else -1
        away = squares + squares[node] - 2 * (x @ x[node])
        closer = away < near
        near[closer & ~out], via[closer & ~out] = away[closer & ~out], node
    vectors = vectors[order]
    edge = np.sqrt(((vectors - vectors[np.maximum(parent, 0)]).astype(float) ** 2).sum(1))
    return Tree(names[order], ids[order], labels[order], vectors, parent, edge * (1 + 1e-9))


@dataclass
class Found:
    """The best rows so far of one question: ids and scores, best first, and how many are wanted."""

    want: int
    ids: np.ndarray
    scores: np.ndarray

    @classmethod
    def none(cls, want: int) -> Found:
        return cls(want, np.zeros(0, np.int64), np.zeros(0, np.int64))

    def floor(self) -> float:
        """A score that a further row has to reach; equal scores may still win by a smaller id."""
        return self.scores[-1] if len(self.ids) >= self.want else -np.inf

    def take(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.want]
        self.ids, self.scores = ids[order], scores[order]


def kth(values: np.ndarray, k: int) -> float:
    """The kth greatest value, minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def bounded(tree: Tree, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, Callable]]:
    """(place of an anchor, low, high, score) along the tree: bounds of its score for every row.

    The root is scored for all rows. A child's score differs from its parent's by at most the edge's length times the
    row's norm. score(open) gives the places of the open rows and their exact scores; these tighten the bounds of the
    anchor's children.
    """
    norm = np.sqrt((rows.astype(float) ** 2).sum(1)) * (1 + 1e-9)
    x, vectors = comparable(rows, tree.vectors)
    last = {p: k for k, p in enumerate(tree.parent.tolist()) if p >= 0}
    held = {}
    for k, p in enumerate(tree.parent.tolist()):
        if p < 0:
            low = (x @ vectors[k]).astype(float)
            high = low
        else:
            # Scores are whole numbers; the half covers what doubles round off.
            reach = tree.edge[k] * norm + 0.5
            low, high = held[p][0] - reach, held[p][1] + reach
        if k in last:
            held[k] = (low.copy(), high.copy())

        def score(open_: np.ndarray, k: int = k) -> tuple[np.ndarray, np.ndarray]:
            at = np.flatnonzero(open_)
            exact = x[at] @ vectors[k] if 2 * len(at) < len(x) else (x @ vectors[k])[at]
            if k in held:
                for side in held[k]:
                    side[at] = exact
            return at, exact.astype(np.int64)

        yield k, low, high, score
        if p >= 0 and last[p] == k:
            del held[p]


def positives_of(tree: Tree, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, found: list[Found]) -> int:
    """Take the rows of a block into each anchor's best rows of its own label; gives the number of rows scored below the root."""
    asked = 0
    for k, low, high, score in bounded(tree, rows):
        same = (labels == tree.labels[k]) & (ids != tree.ids[k])
        least = max(found[k].floor(), kth(low[same], found[k].want))
        at, exact = score(same & (high >= least))
        asked += len(at) * (tree.parent[k] >= 0)
        found[k].take(ids[at], exact)
    return asked


def negatives_of(tree: Tree, windows: list[list[tuple[int, int]]], ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, found: list[list[Found]]) -> int:
    """Take the rows of a block into the best rows of another label in each window (least, most) of each anchor."""
    asked = 0
    for k, low, high, score in bounded(tree, rows):
        other = labels != tree.labels[k]
        open_ = np.zeros(len(ids), bool)
        for (least, most), best in zip(windows[k], found[k], strict=True):
            inside = other & (high >= least) & (low <= most)
            sure = low[inside & (low >= least) & (high <= most)]
            open_ |= inside & (high >= max(best.floor(), kth(sure, best.want)))
        at, exact = score(open_)
        asked += len(at) * (tree.parent[k] >= 0)
        for (least, most), best in zip(windows[k], found[k], strict=True):
            fit = (exact >= least) & (exact <= most)
            best.take(ids[at][fit], exact[fit])
    return asked


def window(positive_score: int) -> tuple[int, int]:
    """Least and greatest whole score s with LOW_PERCENT * positive <= 100 * s <= HIGH_PERCENT * positive."""
    return -(-LOW_PERCENT * positive_score // 100), HIGH_PERCENT * positive_score // 100


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and vectors of the rows of one length, at most BLOCK at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, BLOCK):
            part = batch.slice(begin, BLOCK)
            fit = part.filter(pc.equal(part.column("dims"), dims))
            if fit.num_rows:
                vectors = fit.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)
                yield fit.column("id").to_numpy(), fit.column("label").to_numpy(), vectors


def best_positives(rows: DataFrame, tree: Tree, k: int) -> DataFrame:
    """(anchor, positive_id, positive_score): each task's k best rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Found.none(k) for _ in tree.ids]
        for block in blocks(batches, tree.vectors.shape[1]):
            positives_of(tree, *block, found)
        anchors = np.repeat(tree.names, [len(f.ids) for f in found])
        columns = [anchors, *(np.concatenate([getattr(f, name) for f in found]) for name in ("ids", "scores"))]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "positive_id", "positive_score"])

    return rows.mapInArrow(run, "anchor long, positive_id long, positive_score long")


def best_negatives(rows: DataFrame, tree: Tree, places: list[list[int]], windows: list[list[tuple[int, int]]], k: int) -> DataFrame:
    """(anchor, place, negative_id, negative_score): each task's k best rows in the window of the anchor's positive of that place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[Found.none(k) for _ in w] for w in windows]
        for block in blocks(batches, tree.vectors.shape[1]):
            negatives_of(tree, windows, *block, found)
        flat = [(name, place, f) for name, ps, fs in zip(tree.names.tolist(), places, found, strict=True) for place, f in zip(ps, fs, strict=True) if len(f.ids)]
        sizes = [len(f.ids) for _, _, f in flat]
        columns = [np.repeat(np.array([x[i] for x in flat], np.int64), sizes) for i in (0, 1)]
        columns += [np.concatenate([np.zeros(0, np.int64), *(getattr(f, name) for _, _, f in flat)]) for name in ("ids", "scores")]
        yield pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], names=["anchor", "place", "negative_id", "negative_score"])

    return rows.mapInArrow(run, "anchor long, place long, negative_id long, negative_score long")


def numbered(anchors: DataFrame) -> DataFrame:
    """anchors (id, label, dims, v) in packs of one length and at most PASS_BYTES: dims, names, ids, labels, data; names are different numbers."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def made(dims: int) -> pa.RecordBatch:
            parts = [np.array(x, "<i8") for x in zip(*held.pop(dims), strict=True)]
            return pa.record_batch([pa.array([dims], pa.int32()), *(pa.array([x.tobytes()]) for x in parts)], names=["dims", "names", "ids", "labels", "data"])

        for batch in batches:
            for row in batch.to_pylist():
                pack_ = held.setdefault(row["dims"], [])
                pack_.append((row["name"], row["id"], row["label"], row["v"]))
                if 8 * row["dims"] * (len(pack_) + 1) > PASS_BYTES:
                    yield made(row["dims"])
        for dims in list(held):
            yield made(dims)

    named = stored(anchors.withColumn("name", F.monotonically_increasing_id()))
    return stored(named.mapInArrow(pack, "dims int, names binary, ids binary, labels binary, data binary").withColumn("pack", F.monotonically_increasing_id()))


def unpacked(row) -> Tree:
    names, ids, labels, data = (np.frombuffer(row[c], "<i8") for c in ("names", "ids", "labels", "data"))
    return spanning_tree(names, ids, labels, data.reshape(-1, row.dims))


def mined(
    vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    key: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives` best rows of
    the same label, the `negatives` best rows of other labels whose score lies between LOW_PERCENT and HIGH_PERCENT of the positive's.

    Scores are inner products of floor(scale * x), ties go to the smaller id. Rows with a null key or label, a null or empty
    vector or a null or non-finite component take no part; vectors meet only those of equal length. Rows with the anchor's own id are not its
    positives. Repeated rows count as often as they stand in the table; equal anchor rows are one anchor, different rows of
    one id are anchors of their own. A window of a positive score of 0 holds scores of 0, one of a negative score nothing. Scores have to
    stay below 2**63.

    Anchors come in packs of bounded size, each with a spanning tree, and every pack meets all rows where these lie: rows
    are not shuffled. Each task keeps its best rows per question, and a window over these merges the tasks.
    """
    label = F.col(label) if isinstance(label, str) else label
    plain = vectors.select(F.col(key), F.col(vector), label.cast("long").alias("_label"), F.coalesce(is_anchor, F.lit(False)).alias("_anchor"))
    fit = integer_vectors(plain.filter("_label IS NOT NULL"), key, vector, scale, ["_label", "_anchor"])
    rows = stored(fit.select("id", F.col("_label").alias("label"), "dims", "v", F.col("_anchor").alias("anchor")))
    packs = numbered(rows.filter("anchor").select("id", "label", "dims", "v").distinct())
    rows = rows.drop("anchor")
    out = None
    # One pack at a time is on the driver and with the tasks.
    for number in sorted(r.pack for r in packs.select("pack").toLocalIterator()):
        tree = unpacked(packs.filter(F.col("pack") == number).first())
        place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id"))
        found = best_positives(rows, tree, positives).withColumn("place", place).filter(F.col("place") <= positives)
        first = stored(found)
        held: dict[int, list] = {}
        for r in sorted(first.collect(), key=lambda r: (r.anchor, r.place)):
            held.setdefault(r.anchor, []).append((r.place, window(r.positive_score)))
        asked = [held.get(name, []) for name in tree.names.tolist()]
        best = best_negatives(rows, tree, [[p for p, _ in x] for x in asked], [[w for _, w in x] for x in asked], negatives)
        rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id"))
        kept = best.withColumn("rank", rank).filter(F.col("rank") <= negatives)
        names = found.sparkSession.createDataFrame(list(zip(tree.names.tolist(), tree.ids.tolist(), strict=True)), "anchor long, anchor_id long")
        joined = stored(kept.join(first, ["anchor", "place"]).join(F.broadcast(names), "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
        out = joined if out is None else out.union(joined)
    if out is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, moved)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), fitting AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM fitting WHERE rank <= 10
"""
