"""Parquet sources and sinks of the model tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfprice.schemas import TABLES

#: Days that an append names one by one to the scan; more are read as one range.
MOST_DAYS = 400
#: Rows of a large day that a task brings together and writes, some hundred bytes each.
ROWS_PER_PIECE = 500_000
#: Rows of a task that reads pages or payloads, some milliseconds each.
ROWS_PER_TASK = 2_000


_COLUMNS = [f.name for f in TABLES["observations"]]


def spread(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The same rows, dealt evenly to tasks of a bounded number of rows.

    For rows of few bytes that dear steps follow: scans are cut by bytes, so a few tasks would take them all. The rows are counted first.
    """
    tasks = rows.count() // rows_per_task + 1
    return rows.repartition(tasks) if tasks > 1 else rows


def read_tables(spark: SparkSession, path: str, names: Sequence[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The model tables, or the named ones, under a folder, with their declared schemas.

    Observations also have scrape_date, the day folder they are stored in.
    """
    return {name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}") for name in names}


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """The stored observations with their scrape_date; no rows where nothing has been stored yet."""
    schema = T.StructType([*TABLES["observations"].fields, T.StructField("scrape_date", T.DateType())])
    try:
        return spark.read.schema(schema).parquet(f"{path}/observations")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def _identity() -> Column:
    """What makes two observations of a day the same: the identifier, or the content of a row without one."""
    return F.coalesce("observation_id", F.sha2(F.to_json(F.struct(*_COLUMNS)), 256))


def _day_number() -> Column:
    """The day as a number; rows without a moment have no day and get the least number, which is no date's."""
    return F.coalesce(F.datediff("scrape_date", F.lit("1970-01-01").cast("date")), F.lit(-(2**31)))


def of_days(table: DataFrame, days: DataFrame) -> DataFrame:
    """The rows of the given days (scrape_date), and those without a day; only these folders, or those between the first and the last day, are read."""
    wanted = [r.scrape_date for r in days.distinct().limit(MOST_DAYS + 1).collect()]
    undated = F.col("scrape_date").isNull()
    if len(wanted) <= MOST_DAYS:
        return table.filter(F.col("scrape_date").isin([d for d in wanted if d is not None]) | undated)
    ends = days.agg(F.min("scrape_date").alias("low"), F.max("scrape_date").alias("high")).first()
    return table.filter(F.col("scrape_date").between(ends.low, ends.high) | undated)


def _keyed(rows: DataFrame) -> DataFrame:
    """The observations under their day and identity; the identifier goes as part of the key, the day as its number."""
    others = [c for c in _COLUMNS if c != "observation_id"]
    return rows.select(
        _day_number().alias("_day"), _identity().alias("_identity"), F.col("observation_id").isNotNull().alias("_named"), *others
    )


def _unkeyed(keyed: DataFrame) -> DataFrame:
    rows = keyed.withColumn("observation_id", F.when(F.col("_named"), F.col("_identity")))
    return rows.select(*_COLUMNS, F.to_date("scraped_at").alias("scrape_date"))


def _dated(rows: DataFrame) -> DataFrame:
    return rows.select(*_COLUMNS, F.to_date("scraped_at").alias("scrape_date"))


def missing_observations(rows: DataFrame, path: str) -> DataFrame:
    """The observations, with their scrape_date, that the table under a path doesn't hold yet, each once."""
    dated = _dated(rows)
    return _missing(dated, of_days(read_observations(rows.sparkSession, path), dated.select("scrape_date")))


def _missing(dated: DataFrame, stored: DataFrame) -> DataFrame:
    # Both steps have the same keys, none of them null, so the rows are shuffled once for them.
    key = [_day_number().alias("_day"), _identity().alias("_identity")]
    fresh = _keyed(dated).join(stored.select(*key), ["_day", "_identity"], "left_anti")
    return _unkeyed(fresh.dropDuplicates(["_day", "_identity"]))


def _day_sizes(dated: DataFrame) -> dict:
    """Rows of each day; none if the days are more than are named one by one."""
    sizes = dated.groupBy("scrape_date").count().limit(MOST_DAYS + 1).collect()
    return {r.scrape_date: r["count"] for r in sizes} if len(sizes) <= MOST_DAYS else {}


def _once_by_day(dated: DataFrame, sizes: dict) -> DataFrame:
    """The observations, each once, dealt by day, large days in pieces of about ROWS_PER_PIECE: the shuffle that brings equal ones together also brings a day's."""
    epoch = date(1970, 1, 1)
    pieces = {(d - epoch).days: n // ROWS_PER_PIECE + 1 for d, n in sizes.items() if d is not None} | {
        -(2**31): n // ROWS_PER_PIECE + 1 for d, n in sizes.items() if d is None
    }
    of_day = F.create_map(*[F.lit(x) for pair in pieces.items() for x in pair])[F.col("_day")]
    # A piece follows from the day and the identity, so equal observations share theirs.
    dealt = _keyed(dated).withColumn("_piece", F.pmod(F.xxhash64("_identity"), of_day).cast("int")).repartition(max(2, sum(pieces.values())), "_day", "_piece")
    return _unkeyed(dealt.dropDuplicates(["_day", "_piece", "_identity"]))


def append_observations(rows: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Append the observations that the table doesn't hold yet, in daily folders, sorted by product so that scans can skip row groups.

    An observation is known by its day and identifier, so a repeated run adds nothing, and one that broke off while it wrote
    adds what is missing; rows are never rewritten and other days are not read. The days are read
    from the rows first: store rows that are dear to compute. One writer at a time. Days that hold nothing yet get their rows by one
    shuffle. Else what is new is dealt anew: the rebalance joins small days and splits large ones by their measured size. rows_per_file bounds a file.
    """
    spark, dated = rows.sparkSession, _dated(rows)
    sizes = _day_sizes(dated)
    days = spark.createDataFrame([(d,) for d in sizes], "scrape_date date") if sizes else dated.select("scrape_date")
    stored = of_days(read_observations(spark, path), days)
    if sizes and stored.isEmpty():
        _write_dealt(_once_by_day(dated, sizes), f"{path}/observations", rows_per_file, "append")
    else:
        _write_days(_missing(dated, stored), f"{path}/observations", rows_per_file, "append")


def compact_observations(spark: SparkSession, path: str, days: Sequence[str], rows_per_file: int = 5_000_000) -> None:
    """Write the named days anew in few sorted files; other days keep theirs. Readers of these days have to wait."""
    rows = read_observations(spark, path).filter(F.col("scrape_date").isin(*[F.lit(d).cast("date") for d in days]))
    _write_days(rows, f"{path}/observations", rows_per_file, "overwrite")


def _write_days(rows: DataFrame, path: str, rows_per_file: int, mode: str) -> None:
    _write_dealt(rows.hint("rebalance", "scrape_date"), path, rows_per_file, mode)


def _write_dealt(rows: DataFrame, path: str, rows_per_file: int, mode: str) -> None:
    (
        rows.sortWithinPartitions("scrape_date", "product_id", "scraped_at")
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("scrape_date").parquet(path)
    )
