"""Scheduled jobs over a folder in which captures arrive: each run goes on where the last one ended."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfprice.operators import dml, history
from shelfprice.plans import jobs
from shelfprice.schemas import RUNS
from shelfprice.sources.html_offers import detail_rejects, extract_detail_price
from shelfprice.sources.tables import append_observations, of_days, read_observations
from shelfprice.streaming.runs import run_available, write_batch

#: A job reads a micro-batch of captures, the observations before it and the moment of its run. It gives new observations, and the stores
#: (slug, error_message) whose scrape broke off, or None.
Job = Callable[[DataFrame, DataFrame, str], tuple[DataFrame, DataFrame | None]]
_RUN = T.StructType([f for f in RUNS if f.name != "run_id"])


def utc_now(batch_id: int) -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def run_captures(
    spark: SparkSession, captures: DataFrame, path: str, job: Job, stores: DataFrame, clock: Callable[[int], str] = utc_now
) -> DataFrame:
    """Run a job over the captures that have arrived since its last run; gives the run log (read_runs).

    captures is a stream of captures, stores (store_id, slug) the shops that runs are logged for. Under path lie the observations, the run log
    and the checkpoint, which together are the job's progress. Each micro-batch is one run:

    1. RUNNING rows with the moment of the run are written, once: a run that is taken up again keeps its moment.
    2. The job's observations are appended. Their identifiers come from product, store and moment, so those that a
       broken-off attempt left behind are not added twice.
    3. The rows that say how the run ended are written, counted from what is stored.

    A crash at any place leaves a RUNNING row, and the next call repeats the batch with the same result. clock gives
    the moment of a run and has to differ between runs.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        started = _moment(session, path, batch_id)
        if started is None:
            here = stores.join(batch.select(F.col("store_slug").alias("slug")).distinct(), "slug", "left_semi")
            write_batch(dml.started_runs(here, clock(batch_id)), batch_id, f"{path}/started")
            started = _moment(session, path, batch_id)
        if started is None:
            # No capture of a known store.
            return
        moment = F.lit(started).cast("timestamp_ntz")
        before = read_observations(session, path).filter(F.col("scraped_at") < moment)
        new_rows, failures = job(batch, before, started)
        append_observations(new_rows, path)
        day = session.range(1).select(F.to_date(moment).alias("scrape_date"))
        written = of_days(read_observations(session, path), day).filter(F.col("scraped_at") == moment)
        counts = written.groupBy("store_id").agg(F.count("*").alias("_n"))
        ended = _batch(session, f"{path}/started", batch_id).select("store_id").join(counts, "store_id", "left")
        if failures is None:
            ended = ended.withColumn("error_message", F.lit(None).cast("string"))
        else:
            errors = failures.groupBy("slug").agg(F.min("error_message").alias("error_message"))
            ended = ended.join(stores.select("store_id", "slug").join(errors, "slug").drop("slug"), "store_id", "left")
        ended = ended.select("store_id", F.coalesce("_n", F.lit(0)).alias("products_scraped"), "error_message")
        write_batch(dml.run_rows(ended, started, max(started, clock(batch_id))), batch_id, f"{path}/finished")

    run_available(captures.writeStream.foreachBatch(handle), f"{path}/checkpoint")
    return read_runs(spark, path)


def _batch(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.schema(_RUN).parquet(f"{path}/batch_id={batch_id}")


def _moment(spark: SparkSession, path: str, batch_id: int) -> str | None:
    """When the run of a micro-batch began, if its RUNNING rows are there."""
    try:
        return _batch(spark, f"{path}/started", batch_id).agg(F.max("started_at").cast("string")).first()[0]
    except AnalysisException:
        return None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and store, as it ended, or RUNNING where it hasn't. batch_id numbers the runs."""
    fields = T.StructType([*_RUN.fields, T.StructField("batch_id", T.LongType())])

    def log(name: str) -> DataFrame:
        try:
            return spark.read.schema(fields).option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
        except AnalysisException:
            return spark.createDataFrame([], fields)

    finished = log("finished")
    return finished.unionByName(log("started").join(finished, ["batch_id", "store_id"], "left_anti"))


def rescrape_job(products: DataFrame, stores: DataFrame, registered: DataFrame) -> Job:
    """The daily job: captured product pages give the current price of every known URL."""

    def job(batch: DataFrame, before: DataFrame, moment: str) -> tuple[DataFrame, None]:
        details = extract_detail_price(batch)
        result = jobs.rescrape(before, products, stores, registered, details, moment, moment, page_rejects=detail_rejects(batch))
        return result.new_rows, None

    return job


def discover_job(products: DataFrame, stores: DataFrame) -> Job:
    """The weekly job: captured search results of the active products, the best of each store."""
    from shelfprice.sources.extract import extract_offers

    def job(batch: DataFrame, before: DataFrame, moment: str) -> tuple[DataFrame, None]:
        offers, _ = extract_offers(batch)
        return jobs.discover(products, offers, stores, before, moment).new_rows, None

    return job


def known_urls(observations: DataFrame, products: DataFrame) -> DataFrame:
    """What has to be captured for the daily job: the newest URL of each active product and store."""
    return history.latest_with_url(observations, products).select("product_id", "store_id", "url")
