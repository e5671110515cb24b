"""Ranked lexical search: documents of equal bags over the items' vocabulary are one class, scored once."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import BATCH_BYTES, map_batches, read_table, stored

TOP = 10
#: Constants of the score: thousandths of a weight, of the saturation and of the length's share, and the scale of a term's part.
WEIGHT, SATURATION, LENGTH_PERCENT, SCALE = 1000, 8, 75, 1_000_000_000
#: Terms of the vocabulary that tasks look up in memory; a larger vocabulary is met in a join.
VOCABULARY_TERMS = 200_000
#: Terms of items that one pass over the classes scores; classes, and cells of classes by terms, that are multiplied at a time.
PASS_TERMS, BLOCK, CELLS = 50_000, 512, 4 << 20
#: ASCII letters and digits in lower case, any other ASCII character as a space, all further bytes of UTF-8 as they are.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
LAST = np.iinfo(np.int64).max
TERMS = "n long, terms array<string>, counts array<int>"


def pieces(data: bytes) -> Iterator[bytes]:
    """Runs of about BATCH_BYTES that end between terms."""
    start = 0
    while start < len(data):
        end = data.find(b" ", start + BATCH_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end]
        start = end


def bag(text: bytes | None, vocabulary: frozenset[bytes] | None) -> tuple[int, list[bytes], list[int]]:
    """Number of terms of a whole text, and its distinct terms in order with their numbers; only those of the vocabulary, if one is given."""
    counts: Counter = Counter()
    for piece in pieces((text or b"").translate(TERM_BYTES)):
        counts.update(piece.split())
    held = sorted(counts if vocabulary is None else counts.keys() & vocabulary)
    return sum(counts.values()), held, [counts[t] for t in held]


def bags(rows: DataFrame, vocabulary: frozenset[bytes] | None) -> DataFrame:
    """rows (key, text) as (key, n, terms, counts)."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [bag(x, vocabulary) for x in batch.column(1).cast(pa.binary()).to_pylist()]
        terms = pa.array([t for _, t, _ in made], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        return pa.record_batch([batch.column(0), pa.array([n for n, _, _ in made], pa.int64()), terms, pa.array([c for _, _, c in made], pa.list_(pa.int32()))], names=["key", "n", "terms", "counts"])

    return map_batches(rows, each, f"key {dict(rows.dtypes)['key']}, {TERMS}")


def restricted(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """docs (key, text) as (key, n, terms, counts), terms being those of the vocabulary (term).

    A vocabulary of at most VOCABULARY_TERMS goes with the tasks; for a larger one every distinct term of a document becomes a row and
    meets it in a join. The result is the same.
    """
    known = vocabulary.limit(VOCABULARY_TERMS + 1).toArrow().column("term").cast(pa.binary()).to_pylist()
    if len(known) <= VOCABULARY_TERMS:
        return stored(bags(docs, frozenset(known)))
    whole = stored(bags(docs, None).withColumn("row", F.monotonically_increasing_id()))
    each = whole.select("row", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("row", F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    met = each.join(vocabulary, "term").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("term", "count"))).alias("held"))
    held = F.coalesce("held", F.expr("cast(array() AS array<struct<term: string, count: int>>)"))
    return stored(whole.select("row", "key", "n").join(met, "row", "left").select("key", "n", held["term"].alias("terms"), held["count"].alias("counts")))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(m, terms, counts, members): documents of equal bags and equal m, with their k smallest keys in ascending order, nulls last.

    rows are (key, m, terms, counts). Equal hashes bring documents together and the vectors themselves tell them apart. As members of a class score
    alike and ties go to smaller keys, no answer of k rows reaches beyond its first k; Spark drops the others before the
    shuffle, so a class of a third of all documents sends k rows for each partition it stands in.
    """
    by = ["hash", "m", "terms", "counts"]
    hashed = rows.withColumn("hash", F.xxhash64("m", "terms", "counts"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("key").asc_nulls_last()))
    member = F.struct(F.col("place"), F.col("key"))
    kept = hashed.withColumn("place", first).filter(F.col("place") <= k)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list(member)).alias("members")).select("m", "terms", "counts", F.col("members.key").alias("members"))


class Items:
    """Items of one pass: the weights of their terms and a matrix of term numbers by items."""

    def __init__(self, items: list[int], rows: list[tuple[str, int, int, int]]) -> None:
        """rows are (term, weight, number of the item, count)."""
        numbers = {item: i for i, item in enumerate(items)}
        terms = sorted({r[0] for r in rows})
        at = {t: i for i, t in enumerate(terms)}
        self.items, self.terms = items, pa.array(terms, pa.string())
        self.weights = np.zeros(len(terms), np.int64)
        row, column, count = (np.zeros(len(rows), np.int64) for _ in range(3))
        for i, (term, weight, item, n) in enumerate(rows):
            self.weights[at[term]] = weight
            row[i], column[i], count[i] = at[term], numbers[item], n
        order = np.argsort(column, kind="stable")
        self.rows, self.counts = row[order], count[order]
        self.ends = np.searchsorted(column[order], np.arange(len(items)), "right")

    def scores(self, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Scores of documents by items, in 64-bit integers: each entry is (doc, term, tf), m stands per document."""
        part = np.zeros((len(self.terms), len(m)), np.int64)
        part[term, doc] = self.weights[term] * ((SCALE * tf) // (WEIGHT * tf + SATURATION * m[doc]))
        out = np.zeros((len(self.items), len(m)), np.int64)
        start = 0
        for i, end in enumerate(self.ends.tolist()):
            out[i] = self.counts[start:end] @ part[self.rows[start:end]]
            start = end
        return out


def best_classes(made: DataFrame, items: Items, k: int) -> DataFrame:
    """(item, score, members): each task's k best classes of every item, by score and then by the smallest member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(items.items)
        step = max(1, min(BLOCK, CELLS // max(1, len(items.terms), size)))
        scores, lowest = np.zeros((size, 0), np.int64), np.zeros((size, 0), np.int64)
        lists = np.zeros((size, 0), object)
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                column = part.column("terms")
                term = pc.index_in(column.flatten(), value_set=items.terms)
                doc = pc.list_parent_indices(column).to_numpy().astype(np.int64)
                tf = part.column("counts").flatten().to_numpy().astype(np.int64)
                known = pc.is_valid(term).to_numpy(zero_copy_only=False)
                term = pc.fill_null(term, 0).to_numpy().astype(np.int64)
                found = items.scores(part.column("m").to_numpy(), doc[known], term[known], tf[known])
                members = np.empty(part.num_rows, object)
                members[:] = part.column("members").to_pylist()
                # Null keys come last.
                low = np.array([LAST if x[0] is None else x[0] for x in members.tolist()], np.int64)
                scores, lowest = np.hstack([scores, found]), np.hstack([lowest, np.broadcast_to(low, found.shape)])
                lists = np.hstack([lists, np.broadcast_to(members, found.shape)])
                order = np.lexsort((lowest, -scores), axis=1)[:, :k]
                scores, lowest, lists = (np.take_along_axis(x, order, 1) for x in (scores, lowest, lists))
        item, place = np.nonzero(scores > 0)
        yield pa.record_batch(
            [pa.array(np.array(items.items, np.int64)[item], pa.int64()), pa.array(scores[item, place], pa.int64()), pa.array(lists[item, place].tolist(), pa.list_(pa.int64()))],
            names=["item", "score", "members"],
        )

    return made.mapInArrow(run, "item long, score long, members array<long>")


def ranked(
    docs: DataFrame, items: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item key, rank, doc key, score): the k documents of highest score above 0 for every item, ties by ascending key.

    Terms are runs of ASCII letters and digits, A-Z in lower case, and of any characters beyond ASCII. Every row of docs is a document of its own, repeated
    rows and keys too; null keys take part and come last among equal scores. Rows without terms, null texts included, have no
    part in the statistics and are never found. Distinct (item key, item text) are the items: repeated rows are one
    item, an item without known terms gives no row, and each text of a repeated key is ranked for itself. Keys are 64-bit integers. Scores
    have to stay below 2**63.

    Documents are cut to the items' vocabulary in one pass over the texts, classes of equal vectors are made, and items
    meet all classes, in passes of at most PASS_TERMS terms of items, so that what a pass sends to tasks is bounded.
    """
    known = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).distinct()
    known = stored(bags(known.select(F.struct("item_id", "text").alias("key"), "text"), None).select(F.xxhash64("key").alias("item"), "key.item_id", "terms", "counts"))
    entries = known.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.counts").alias("count"))
    held = restricted(docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), stored(entries.select("term").distinct()))
    empty = held.sparkSession.createDataFrame([], f"{item_key} long, rank int, {key} long, score long")
    total = held.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        return empty
    m = F.expr(f"{100 - LENGTH_PERCENT} + (({LENGTH_PERCENT} * n * {total.docs}L) div {total.terms}L)")
    made = stored(classes(held.filter(F.size("terms") > 0).select("key", m.alias("m"), "terms", "counts"), k))
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(float(WEIGHT)) * F.log(F.lit(float(2 * total.docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    weighed = entries.join(df, "term").select("item", "term", weight.alias("weight"), "count")
    passes = -(-entries.count() // PASS_TERMS)
    weighed = stored(weighed.withColumn("turn", F.pmod("item", F.lit(passes)) if passes else F.lit(0)))
    found = []
    for turn in range(passes):
        rows = [tuple(r) for r in weighed.filter(F.col("turn") == turn).select("term", "weight", "item", "count").collect()]
        found.append(stored(best_classes(made, Items(sorted({r[2] for r in rows}), rows), k)))
    if not found:
        return empty
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    # A class that is among the k best of its task may still miss the k best of all: only these are expanded.
    leading = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("members")[0].asc_nulls_last()))
    expanded = best.withColumn("place", leading).filter(F.col("place") <= k).select("item", "score", F.explode("members").alias("key"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))
    top = expanded.withColumn("rank", rank).filter(F.col("rank") <= k)
    return top.join(known.select("item", "item_id"), "item").select(F.col("item_id").alias(item_key), "rank", F.col("key").alias(key), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), sized AS (
  SELECT rid, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM cut WHERE len(w) > 0
), whole AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM sized
), wanted AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
), tfs AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY rid, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term, nn
), parts AS (
  SELECT t.rid, s.doc_id, t.term, g.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // l))) AS part
  FROM tfs t JOIN sized s USING (rid) JOIN weights g USING (term), whole
), scored AS (
  SELECT item_id, rid, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, rid, doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""
