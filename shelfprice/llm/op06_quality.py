"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import fold, labelled_sample, map_batches, read_table

#: Buckets of hashed words, bins of a statistic, rank of the interactions.
WORD_BUCKETS, BINS, RANK = 4096, 12, 8
#: Labelled rows that a model is fitted on at most, which bounds the matrix on the driver.
SAMPLE_ROWS = 10_000
EPOCHS, BATCH, RATE, RIDGE = 40, 256, 0.02, 2e-3
THRESHOLD = 0.5
MEMO_WORDS = 400_000

STATISTICS = (
    "chars", "words", "word_length", "distinct_words", "distinct_pairs", "lines", "distinct_lines", "line_length",
    "upper", "digits", "stops", "symbols", "beyond_ascii", "bangs", "bars", "tripled", "longest_word", "top_word",
)


class Buckets(dict):
    """Bucket of a word; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        bucket = self[word] = zlib.crc32(word.encode()) % WORD_BUCKETS
        return bucket


def statistics(text: str) -> tuple[list[float], list[str]]:
    """Structure statistics of a text in the order of STATISTICS, and its words in lower case."""
    data = text.encode()
    kinds = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    n, size = max(1, len(words)), max(1, len(data))
    low = text.lower().split()
    counts: dict[str, int] = {}
    for w in low:
        counts[w] = counts.get(w, 0) + 1
    symbols = sum(int(kinds[ord(c)]) for c in "#$%&*+<=>@[]\\^_`{}~")
    tripled = sum(text.count(3 * c) for c in "#$%&*+=_~")
    return [
        math.log1p(len(data)), math.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n,
        len(set(zip(low, low[1:], strict=False))) / n, math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(size / len(lines)),
        kinds[65:91].sum() / size, kinds[48:58].sum() / size, int(kinds[46] + kinds[44]) / n, symbols / n,
        kinds[128:].sum() / size, int(kinds[33]) / n, int(kinds[124]) / n, tripled / n,
        math.log1p(max(map(len, words), default=0)), max(counts.values(), default=0) / n,
    ], list(counts)


@dataclass
class Machine:
    """Factorisation machine over word buckets, bins of statistics and bins of metadata, all as sparse features."""

    edges: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def columns(self, values: np.ndarray) -> np.ndarray:
        """Feature numbers of statistics and metadata: one bin each, the last bin for missing values."""
        width = BINS + 1
        bins = np.array([BINS if math.isnan(v) else np.searchsorted(e, v, "right") for v, e in zip(values, self.edges, strict=True)])
        return WORD_BUCKETS + np.arange(len(values)) * width + bins

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        """Linear in the number of features: pairwise terms are half of (sum squared minus sum of squares) per factor."""
        at = np.concatenate([buckets, self.columns(values)])
        x = weights(len(buckets), len(values))
        v = self.factors[at] * x[:, None]
        pairs = 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + float(self.linear[at] @ x) + pairs))))


def weights(words: int, statistics: int) -> np.ndarray:
    """All words of a document together weigh one, each statistic weighs one."""
    return np.concatenate([np.full(words, 1 / math.sqrt(max(1, words))), np.ones(statistics)])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], statistics: int) -> Machine:
    """Fit by Adam on logistic loss with a ridge. Without rows of both classes every document scores as its share."""
    values = np.array([v for _, v, _ in rows], float).reshape(-1, statistics)
    y = np.array([label for _, _, label in rows], float)
    edges = np.zeros((statistics, BINS - 1))
    for i in range(statistics):
        there = values[:, i][~np.isnan(values[:, i])]
        if len(there):
            edges[i] = np.quantile(there, np.arange(1, BINS) / BINS)
    size = WORD_BUCKETS + statistics * (BINS + 1)
    machine = Machine(edges, 0.0, np.zeros(size), np.zeros((size, RANK)))
    if not 0 < y.sum() < len(y):
        machine.bias = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return machine
    random = np.random.default_rng(7)
    # A row has some hundred features of several thousand: kept as their numbers, made a dense matrix batch by batch.
    at = [np.concatenate([buckets, machine.columns(v)]).astype(np.int32) for buckets, v, _ in rows]
    x = np.zeros((BATCH, size), np.float32)
    share = y.mean()
    machine.bias = math.log(share / (1 - share))
    theta = np.zeros((size, RANK + 1), np.float32)
    theta[:, 1:] = random.normal(0, 0.02, (size, RANK))
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for begin in range(0, len(y), BATCH):
            part = order[begin:begin + BATCH]
            xb = x[:len(part)]
            xb[:] = 0
            for i, row in enumerate(part.tolist()):
                xb[i, at[row]] = weights(len(at[row]) - statistics, statistics)
            squares = xb * xb
            linear, factors = theta[:, 0], theta[:, 1:]
            sums = xb @ factors
            z = machine.bias + xb @ linear + 0.5 * ((sums**2).sum(1) - squares @ (factors**2).sum(1))
            error = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            slope = np.empty_like(theta)
            slope[:, 0] = xb.T @ error
            slope[:, 1:] = xb.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * factors
            slope += RIDGE / 10 * theta
            machine.bias -= RATE * float(error.sum())
            step += 1
            first += 0.1 * (slope - first)
            second += 0.001 * (slope * slope - second)
            theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-6)
    machine.linear, machine.factors = theta[:, 0].astype(float), theta[:, 1:].astype(float)
    return machine


def features(batch: pa.RecordBatch, memo: Buckets, text: int, metadata: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Word buckets and values (statistics, then log metadata; NaN where missing) of each row."""
    extra = [batch.column(i).to_pylist() for i in metadata]
    out = []
    for row, x in enumerate(batch.column(text).to_pylist()):
        values, words = statistics(x or "")
        values += [math.nan if c[row] is None else math.log1p(max(0.0, float(c[row]))) for c in extra]
        out.append((np.unique(np.fromiter(map(memo.__getitem__, words), np.int64, len(words))), np.array(values, float)))
    return out


def train(docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality", text: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> Machine:
    """Fit a machine on at most SAMPLE_ROWS labelled documents; their features are made in Spark tasks."""
    sample = labelled_sample(docs.select("doc_id", text, *metadata), labels, label, train_rows, SAMPLE_ROWS)
    memo = Buckets()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = features(batch, memo, 1, list(range(3, batch.num_columns)))
        return pa.record_batch(
            [batch.column(0), batch.column(2), pa.array([b.tolist() for b, _ in made], pa.list_(pa.int32())), pa.array([v.tolist() for _, v in made], pa.list_(pa.float64()))],
            names=["doc_id", "y", "buckets", "numbers"],
        )

    made = map_batches(sample.select("doc_id", text, "_y", *metadata), each, "doc_id long, y int, buckets array<int>, numbers array<double>")
    table = made.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS).toArrow()
    buckets, numbers = (lists(table[name].combine_chunks()) for name in ("buckets", "numbers"))
    return fit(list(zip(buckets, numbers, table["y"].to_pylist(), strict=True)), len(STATISTICS) + len(metadata))


def lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def scored(docs: DataFrame, machine: Machine, keep: list[str], text: str = "text", metadata: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """The kept columns and a score from 0 to 1 for each row.

    Null and empty texts are scored like any other from their statistics; missing metadata has its own bin. Repeated
    rows give repeated results.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)
    memo = Buckets()
    inputs = [text, *metadata]
    aliased = [F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.num_columns - len(inputs)
        scores = [model.value.score(b, v) for b, v in features(batch, memo, own, list(range(own + 1, batch.num_columns)))]
        return pa.record_batch([*batch.columns[:own], pa.array(scores, pa.float64())], names=[*batch.schema.names[:own], "score"])

    kept = docs.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", score double"
    return map_batches(docs.select(*keep, *aliased), each, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 3) == 1
    found = scored(docs, train(docs, labels, ~held_out), ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
