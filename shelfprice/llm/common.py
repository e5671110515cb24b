"""What several operators of this subpackage share: inputs, folds, shared tables, Arrow batches, linked groups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of input that a Python task works on at once.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: Rows that a side of a join may have to be broadcast; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Links, of two numbers each, that one task follows; more are followed in rounds.
TASK_LINKS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, of: int) -> Column:
    """Remainder of the CRC-32 of a key's text; null keys fall into fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % of, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below the checkpoint folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        # A plain local session runs in one process, so its own temporary folder is shared.
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame once into the shared folder and read it back; later steps don't compute it again."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small(frame: DataFrame, weight: Column | None = None) -> DataFrame:
    """With a broadcast hint if the frame holds at most BROADCAST_ROWS rows of a few numbers each, else without.

    weight says for how many such rows one row counts, as one with a list does. The frame should be stored, as it is counted.
    """
    held = frame.limit(BROADCAST_ROWS + 1).agg(F.sum(F.lit(1) if weight is None else weight).alias("n")).first()["n"] or 0
    return F.broadcast(frame) if held <= BROADCAST_ROWS else frame


def slices(batch: pa.RecordBatch, size_of_run: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about size_of_run bytes; a longer row stands alone."""
    start, held = 0, 0
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for row, size in enumerate(sizes.tolist()):
        if row > start and (held + size > size_of_run or row - start >= BATCH_ROWS):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """Hand memory that is free back to the system: a Python worker lives on after its task, beside those of the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # Only the GNU C library has it.
    if trim:
        trim(0)


def map_batches(
    frame: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, size_of_run: int = BATCH_BYTES
) -> DataFrame:
    """Apply a function to small slices of Arrow batches inside Spark tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in slices(batch, size_of_run):
                    yield each(part)
        finally:
            give_back()

    return frame.mapInArrow(run, schema)


def linked_groups(links: DataFrame) -> DataFrame:
    """Give (node, root): the smallest node that links reach, for every node that has a link.

    links has long columns a and b; it should be stored, as it is counted. At most TASK_LINKS links are followed by one task. For more, each
    round every node takes the smallest root among its own, its neighbours' and its root's root, so chains shorten by halves; rounds are
    written to the shared folder, and the loop ends when no root changes.
    """
    pairs = links.select("a", "b")
    if pairs.limit(TASK_LINKS + 1).count() <= TASK_LINKS:
        return stored(pairs.coalesce(1).mapInArrow(followed, "node long, root long"))
    return rounds_of_roots(pairs)


def followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of a task, the smaller root on top."""
    root: dict[int, int] = {}

    def top(node: int) -> int:
        while root[node] != node:
            root[node] = node = root[root[node]]
        return node

    for batch in batches:
        for a, b in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            if a != b:
                root.setdefault(a, a)
                root.setdefault(b, b)
                a, b = top(a), top(b)
                root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], names=["node", "root"])


def rounds_of_roots(links: DataFrame) -> DataFrame:
    """linked_groups in rounds over the whole cluster."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct())
    roots = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        closer = (
            roots.join(near, "node")
            .select("node", "root", F.least("root", "near").alias("low"))
        )
        jump = roots.select(F.col("node").alias("low"), F.col("root").alias("jumped"))
        moved = stored(
            closer.join(jump, "low", "left")
            .select("node", F.least("low", "jumped").alias("root"), (F.least("low", "jumped") < F.col("root")).alias("changed"))
        )
        roots = moved.select("node", "root")
        if moved.filter("changed").isEmpty():
            return roots


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int) -> DataFrame:
    """(doc_id, text, label, and the other columns of docs) of at most `rows` labelled documents of the training fold.

    A document with several labels has their majority, ties count as 1; null labels count for nothing. The documents
    are chosen by a hash of their id, so the same data give the same sample. As `rows` bounds the list, it is broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).select("doc_id", F.col(label).alias("_y"))
    known = known.groupBy("doc_id").agg((F.avg("_y") >= 0.5).cast("int").alias("_y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(chosen), "doc_id")
