"""From raw documents to clean token ids: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfprice.llm import op03_jaccard, op05_bpe, op06_quality, op08_secrets, op10_decontaminate
from shelfprice.llm.common import read_table, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not reject."""
    machine = op06_quality.train(docs, read_table(spark, sf_dir, "labels"), F.lit(True))
    scored = op06_quality.scored(docs, machine, docs.columns)
    return scored.filter(F.col("score") >= op06_quality.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, and one of its rows if it has several.

    Documents without words are in no group and stay.
    """
    return op03_jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return op10_decontaminate.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of every secret and n_chars of the new text."""
    masked = op08_secrets.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, as little-endian unsigned 32-bit integers, and their number."""
    from public_tokenizers import path

    return op05_bpe.encode_documents(docs, path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe),
]

#: SQL has no factorisation machine, secret scan or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
