"""Token counts of documents in flat token files without an index, by a scan for separators."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import map_batches, read_table, shared_folder, stored
from shelfprice.llm.op05_bpe import Encoder, Vocabulary

#: Bytes of a block; a multiple of every token width.
BLOCK_BYTES = 4 << 20
#: Tokens before a document's own ones that hold its key: 15 bits each, so that none can be a separator, the last the sign.
KEY_TOKENS, KEY_BITS = 6, 15
NULL_KEY = 2
TOKEN = "<u2"


def key_tokens(key: int | None) -> list[int]:
    digits = [(abs(key or 0) >> KEY_BITS * i) & ((1 << KEY_BITS) - 1) for i in range(KEY_TOKENS - 1)]
    return [*digits, NULL_KEY if key is None else int(key < 0)]


def key_column(head: str) -> Column:
    """The key that key_tokens() wrote; the least 64-bit integer included."""
    digits = [F.get(head, i).cast("decimal(38,0)") * (1 << KEY_BITS * i) for i in range(KEY_TOKENS - 1)]
    value = sum(digits[1:], digits[0])
    sign = F.get(head, KEY_TOKENS - 1)
    return F.when(sign == 1, -value).when(sign == 0, value).cast("long")


def write_token_files(docs: DataFrame, vocabulary: Vocabulary, separator: int, folder: str, key: str = "doc_id", text: str = "text") -> None:
    """Write whole texts as little-endian 16-bit tokens, each document ended by the separator, key tokens ahead.

    Strings of special tokens are ordinary text, so no document holds the separator. Null and empty texts are documents
    of no token. The files are Spark's text output with the separator's two bytes as line end: rows of raw bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(replace(vocabulary, special={}))
    encoders: list[Encoder] = []

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = encoders[0] if encoders else encoders.append(Encoder(sent.value)) or encoders[0]
        ids, counts = encoder.encode(x or "" for x in batch.column(1).to_pylist())
        ends = np.cumsum(counts)
        rows = [
            np.concatenate([np.array(key_tokens(k)), ids[e - n:e]]).astype(TOKEN).tobytes()
            for k, e, n in zip(batch.column(0).to_pylist(), ends.tolist(), counts.tolist(), strict=True)
        ]
        return pa.record_batch([pa.array(rows, pa.binary())], names=["tokens"])

    end = np.array([separator]).astype(TOKEN).tobytes().decode("latin-1")
    made = map_batches(docs.select(F.col(key).cast("long"), text), each, "tokens binary")
    made.select(F.col("tokens").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", end).text(folder)


def read_range(path: str, offset: int, size: int) -> bytes:
    uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
    files, place = pyarrow.fs.FileSystem.from_uri(uri)
    with files.open_input_file(place) as file:
        file.seek(offset)
        return file.read(size)


def scan_blocks(blocks: DataFrame, separator: int, token: str, head: int) -> DataFrame:
    """For each block (path, block, offset, size, length): its first separator, and starts, ends and head tokens of documents that start in it.

    An end is the place of the separator, null where it lies in a later block. Places count tokens from the file's start.
    """
    width = np.dtype(token).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, offset, size, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = read_range(path, offset, size + head * width)
                tokens = np.frombuffer(raw[: len(raw) // width * width], token)
                inside, first, total = min(len(tokens), size // width), offset // width, length // width
                at = np.flatnonzero(tokens[:inside] == separator)
                starts = np.concatenate([[0] if not block else [], at + 1]).astype(np.int64)
                starts = starts[starts + first < total]
                after = np.searchsorted(at, starts)
                ends = [int(at[i]) + first if i < len(at) else None for i in after.tolist()]
                heads = [tokens[s:s + head].tolist() for s in starts.tolist()]
                yield pa.record_batch(
                    [
                        pa.array([path]), pa.array([block], pa.int64()), pa.array([total], pa.int64()), pa.array([int(at[0]) + first if len(at) else None], pa.int64()),
                        pa.array([(starts + first).tolist()], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([heads], pa.list_(pa.list_(pa.int32()))),
                    ],
                    names=["path", "block", "total", "first_end", "starts", "ends", "heads"],
                )

    return blocks.mapInArrow(run, "path string, block long, total long, first_end long, starts array<long>, ends array<long>, heads array<array<int>>")


def token_counts(spark: SparkSession, folder: str, separator: int, token: str = TOKEN, head: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, document, start, n_tokens, head, closed) of every document of the token files in a folder.

    document counts from 0 within a file. n_tokens leaves out the separator and the first `head` tokens, which are given as
    head. Tokens after a file's last separator are a document that is not closed; a separator after another ends an
    empty document; an empty file has none. Bytes short of a whole token at a file's end are left out.

    Tasks search blocks on their own. Only one narrow row per block meets the others of its file, in running sums: the
    number of documents before it and the next separator after it.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    number = F.floor((F.col("length") - 1) / F.lit(block_bytes)).cast("long")
    blocks = files.filter("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), number)).alias("block"))
    offset = F.col("block") * block_bytes
    blocks = blocks.repartition("path", "block").select("path", "block", offset.alias("offset"), F.least(F.lit(block_bytes), F.col("length") - offset).cast("long").alias("size"), "length")
    found = stored(scan_blocks(blocks, separator, token, head))
    up = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "path", "block", F.coalesce(F.sum(F.size("starts")).over(up), F.lit(0)).alias("base"), F.last("first_end", ignorenulls=True).over(down).alias("next_end"),
    )
    each = found.join(stitched, ["path", "block"]).select(
        "path", "total", "base", "next_end", F.posexplode(F.arrays_zip("starts", "ends", "heads")).alias("i", "d"),
    )
    end = F.coalesce("d.ends", "next_end", "total")
    return each.select(
        "path", (F.col("base") + F.col("i")).alias("document"), F.col("d.starts").alias("start"),
        F.greatest(F.lit(0), end - F.col("d.starts") - head).alias("n_tokens"), F.col("d.heads").alias("head"), (F.coalesce("d.ends", "next_end").isNotNull()).alias("closed"),
    )


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    vocabulary = Vocabulary.load(path("word_bpe_49k.json"))
    separator = vocabulary.special["<|endoftext|>"]
    folder = shared_folder(spark)
    write_token_files(read_table(spark, sf_dir, "documents"), vocabulary, separator, folder)
    counts = token_counts(spark, folder, separator, head=KEY_TOKENS)
    return counts.select(key_column("head").alias("doc_id"), "n_tokens")
