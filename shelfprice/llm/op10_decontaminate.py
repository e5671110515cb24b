"""Benchmark decontamination: test items contained in documents, by size-partitioned MinHash and exact shingles.

Only DataFrame operations: no Python runs in tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm.common import read_table, small, stored

WORDS, PERCENT = 5, 75
#: Words of 64 bits of the filter that document shingles pass before they become rows; a fixed size.
FILTER_WORDS = 1 << 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_words(frame: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """The kept columns and words: A-Z lower-cased, split at ASCII white space.

    The array passes a one-element explode, so that no later step splits the text again.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return frame.select(*keep, F.explode_outer(F.array(words)).alias("words"))


def runs(n: Column) -> Column:
    """Places at which a shingle starts, from 1: one place for a text shorter than a shingle."""
    return F.sequence(F.lit(1), F.greatest(n - (WORDS - 1), F.lit(1)))


def hashes() -> Column:
    """64-bit hashes of the word shingles of `words`; a shorter text is one shingle, none without words."""
    n = F.size("words")
    one = F.transform(runs(n), lambda i: F.xxhash64(*(F.get("words", i + (k - 1)) for k in range(WORDS))))
    return F.when(n > 0, one).otherwise(F.expr("cast(array() AS array<bigint>)"))


def strings() -> Column:
    """The distinct shingles themselves, as strings of words with single spaces."""
    n = F.size("words")
    one = F.array_distinct(F.transform(runs(n), lambda i: F.array_join(F.slice("words", i, F.lit(WORDS)), " ")))
    return F.when(n > 0, one).otherwise(F.expr("cast(array() AS array<string>)"))


def signatures(items: DataFrame, percent: int) -> DataFrame:
    """(item, hash): MinHash signatures of items, the least hashes of each, as many as the item's size partition asks for.

    Partitions double in size. Of n shingles at most n - ceil(n * t) may be missing from a document that contains the
    item, so one more than the largest item of the partition may miss is sure to have a hash in common with it.
    """
    sized = items.withColumn("hashes", F.array_sort(F.array_distinct("hashes"))).filter(F.size("hashes") > 0)
    most = F.pow(F.lit(2.0), F.floor(F.log2(F.size("hashes"))) + 1) - 1
    length = (most - F.ceil(most * percent / 100) + 2).cast("int")
    return sized.select("item", F.explode(F.slice("hashes", F.lit(1), length)).alias("hash"))


def bit_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of hashes against a bit table of fixed size: false only for hashes that are not among the keys."""
    slots = FILTER_WORDS * 64
    words = [0] * FILTER_WORDS
    # One number for each bit at most reaches the driver.
    for r in keys.select(F.pmod("hash", F.lit(slots)).cast("int").alias("slot")).distinct().collect():
        words[r.slot >> 6] |= 1 << (r.slot & 63)
    # A word with its top bit is a negative number; the least of these is no literal and is written as a sum.
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    table = F.expr("array(" + ",".join(f"{w}L" if w > -(1 << 63) else f"{w + 1}L - 1L" for w in signed) + ")")

    def test(h: Column) -> Column:
        slot = F.pmod(h, F.lit(slots)).cast("int")
        return F.getbit(F.get(table, F.shiftright(slot, 6)), slot.bitwiseAND(63)) == 1

    return test


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", percent: int = PERCENT,
) -> DataFrame:
    """(key, text_key, item key, n_shared, n_item): the items of which a document holds at least percent of the shingles.

    Shingles are distinct runs of five words; a shorter text is one shingle, and so meets only texts of the same words.
    Texts without words, and null ones, hold and are contained in nothing. Each pair of a document row and a distinct
    (item key, item text) gives one row, repeated and null document keys included. text_key is a hash of the text.

    Document hashes that pass the bit filter become rows and meet the signatures; what meets is a candidate. The
    candidates' texts are read again and compared shingle by shingle, as strings.
    """
    known = items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text")).distinct()
    known = with_words(known.withColumn("item", F.xxhash64("item_key", "item_text")), "item_text", [F.col("item"), F.col("item_key")])
    known = stored(known.select("item", "item_key", hashes().alias("hashes"), strings().alias("item_shingles")))
    keys = stored(signatures(known, percent))
    text_key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    hashed = with_words(docs, text, [text_key.alias("text_key")])
    passed = hashed.select("text_key", F.explode(F.filter(hashes(), bit_filter(keys))).alias("hash"))
    candidates = stored(passed.join(small(keys), "hash").select("text_key", "item").distinct())
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), text_key.alias("text_key"))
    wanted = small(candidates.select("text_key").distinct())
    again = with_words(texts.join(wanted, "text_key", "left_semi"), "text", [F.col("key"), F.col("text_key")])
    held = again.select("key", "text_key", strings().alias("shingles"))
    pairs = held.join(small(candidates), "text_key").join(small(known.select("item", "item_key", "item_shingles"), F.size("item_shingles")), "item")
    counted = pairs.select(
        F.col("key").alias(key), "text_key", F.col("item_key").alias(item_key),
        F.size(F.array_intersect("shingles", "item_shingles")).cast("long").alias("n_shared"), F.size("item_shingles").cast("long").alias("n_item"),
    )
    return counted.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text contains no item. Rows with one text share its fate."""
    leaks = stored(contained_items(docs.select(F.lit(None).cast("long").alias("row"), F.col(text).alias("body")), items, "row", "body").select("text_key").distinct())
    # The row's columns stay together in one, so that none of them meets the key.
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_key"))
    return marked.join(small(leaks), "text_key", "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


OP10_SQL = """
WITH texts AS (
  SELECT 'doc' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark
), words AS (
  SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM texts
), grams AS (
  SELECT side, id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' ')))) AS g
  FROM words WHERE len(w) > 0
), sizes AS (
  SELECT id, count(*) AS n_item FROM grams WHERE side = 'item' GROUP BY id
)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, n_item
FROM grams d JOIN grams i ON d.side = 'doc' AND i.side = 'item' AND d.g = i.g JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id, n_item HAVING 100 * count(*) >= 75 * n_item
"""
