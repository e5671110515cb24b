"""Language identification as inference in a mixture of languages over character n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import fold, map_batches, read_table, slices

#: Buckets of hashed trigrams, added count of each, rounds of expectation-maximisation.
BUCKETS, SMOOTHING, ROUNDS = 1 << 15, 0.5, 15
#: What a further language costs, in units of half the logarithm of the number of n-grams. Neighbouring n-grams overlap,
#: so their likelihoods count for less than independent ones would.
PENALTY = 6.0
#: Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 64
#: Letters are told apart below this code point; what lies above is taken for letters (ideographs).
TABLE = 0x30000
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(TABLE)]))
    return _letters[0]


def trigrams(text: str) -> np.ndarray:
    """Buckets of a text's trigrams of lower-case letters, with one blank for each run of other characters; empty without letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[np.minimum(codes, TABLE - 1)] | (codes >= TABLE)
    if not letter.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]]).astype(np.uint64)
    codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
    if len(codes) < 3:
        codes = np.concatenate([codes, np.zeros(3 - len(codes), np.uint64)])
    mixed = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (codes[2:] * np.uint64(0x165667B19E3779F9))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(49)).astype(np.int64)


def learn(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in order and P(n-gram | language), buckets by languages, from all training rows.

    Tasks add up counts per language before the shuffle; what reaches the driver is one number for each bucket and
    language, whatever the number of documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch):
                for name, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[name] = held.get(name, 0) + np.bincount(trigrams(x), minlength=BUCKETS)
                if len(held) > HELD_LANGUAGES:
                    yield from passed()
        yield from passed()

    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & train).select(lang, text)
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, len(names)), SMOOTHING)
    table[counts["bucket"].to_numpy(), np.searchsorted(names, counts["lang"])] += counts["n"].to_numpy(dtype=float)
    return names, table / table.sum(0)


def proportions(p: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares of the chosen languages by expectation-maximisation, and the log likelihood of the n-grams under them."""
    q = p[:, chosen]
    shares, total = np.full(len(chosen), 1 / len(chosen)), counts.sum()
    if len(chosen) > 1:
        for _ in range(ROUNDS):
            shares = shares * ((counts / (q @ shares)) @ q) / total
    return shares, float(counts @ np.log(q @ shares))


def mixture(buckets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Languages of a text, by falling share, and their shares.

    Sets grow by the language of the next largest share under all languages; the set of the best likelihood, less
    its penalty, is the text's. They grow until even the greatest likelihood of any shares can't pay for one more language.
    """
    counts = np.bincount(buckets, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    counts, p = counts[at].astype(float), table[at]
    all_shares, reached = proportions(p, counts, np.arange(table.shape[1]))
    order = np.argsort(-all_shares, kind="stable")
    # The likelihood is concave: no shares exceed these by more than their steepest direction allows.
    limit = reached + counts.sum() * math.log(max(1.0, float(((counts / (p @ all_shares)) @ p).max()) / counts.sum()))
    price = PENALTY * 0.5 * math.log(max(2.0, counts.sum()))
    best = None
    for size in range(1, len(order) + 1):
        if best is not None and limit - size * price <= best[0]:
            break
        shares, likelihood = proportions(p, counts, order[:size])
        if best is None or likelihood - size * price > best[0]:
            best = (likelihood - size * price, order[:size], shares)
    ranked = np.argsort(-best[2], kind="stable")
    return best[1][ranked], best[2][ranked]


def languages(docs: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred (the language of the largest share), score (that share) and mixture (languages and shares).

    Null texts and texts without a letter, and every text if no language was learned, give `und`, 0 and an empty
    mixture. Rows map one to one; other columns are left out.
    """
    names, table = model
    learned = docs.sparkSession.sparkContext.broadcast(table)
    pairs = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for x in batch.column(1).to_pylist():
            grams = trigrams(x or "") if names else ()
            found.append([(names[i], float(min(1.0, s))) for i, s in zip(*mixture(grams, learned.value), strict=True)] if len(grams) else [])
        return pa.record_batch(
            [
                batch.column(0), pa.array([f[0][0] if f else "und" for f in found]), pa.array([f[0][1] if f else 0.0 for f in found]),
                pa.array([[{"lang": n, "share": s} for n, s in f] for f in found], pairs),
            ],
            names=[key, "lang_pred", "score", "mixture"],
        )

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), each, f"`{key}` {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3) == 1
    found = languages(docs, learn(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
