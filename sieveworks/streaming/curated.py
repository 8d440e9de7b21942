"""The whole curation run over a stream of search responses.

New landing files of search payloads -> ``readStream`` -> ``foreachBatch``: for
each run date of the batch, in ascending order, hits and source links become
candidates, ``curate`` runs against the pages and the history of the runs
before (URL, title and body within the window, policy, annotation, capped
top-k), and ``publish_run`` writes daily rows, history and index. The source
links are taken, and the pages that a batch's runs ask for looked up, read and
signed, once a batch: these do not depend on the run, and most URLs are asked
for by all of them.

A run is known by its batch id and run date, a mark that history and index
carry. A batch that is replayed after a failure finishes what is missing and no
more: a run that history does not hold is made again from the same history as
the first time; one that only the index lacks is finished from its daily rows
(it would find its own articles in history otherwise); one that both hold is
passed over. A later batch of the same date is a re-run: it leaves out what the
first one published and replaces the day's rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store as ST
from ..operators.candidates import candidates
from ..operators.versions import read_version
from ..operators.views import overview_with
from ..plans.curate import CurateParams, allowed, curate, page_records
from ..session import cut_lineage
from ..sources.search import parse_responses

LANDING_SCHEMA = "run_date string, provider string, term_pos bigint, term string, payload string"


def curate_stream(spark: SparkSession, landing: str, base: str, pages: DataFrame, links: DataFrame, scorer, params: CurateParams,
                  summarise: Callable | None = None, max_files: int | None = None) -> None:
    """Take all files that have arrived in ``landing`` (Parquet, LANDING_SCHEMA, a row a response) and publish their runs under ``base``.

    pages: (page_id, url, html); links: (source_url, url) of the source pages,
    taken in every run; scorer: see ``curate``; ``params.run_date`` gives way
    to that of the rows; ``summarise``: see ``overview_with``. A row without a
    run date is an error.
    """
    source = spark.readStream.schema(LANDING_SCHEMA)
    if max_files:
        source = source.option("maxFilesPerTrigger", max_files)
    run = _batch_runner(base, pages, links, scorer, params, summarise)
    (source.parquet(landing).writeStream.foreachBatch(run).option("checkpointLocation", f"{base}/_checkpoint")
     .trigger(availableNow=True).start().awaitTermination())


def _batch_runner(base: str, pages: DataFrame, links: DataFrame, scorer, params: CurateParams, summarise: Callable | None):
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{base}/batches/batch_id={batch_id}"  # a folder a date, so that a run reads its own rows alone
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("run_date").parquet(path)
        dates = [r.run_date for r in batch.select("run_date").distinct().collect()]
        if None in dates:
            raise ValueError("every landing row needs a run_date")
        landed = spark.read.schema(LANDING_SCHEMA).parquet(path)
        runs = [(run_date, f"{batch_id:019d} {run_date}") for run_date in sorted(dates)]
        new = [run_date for run_date, mark in runs if not ST.published(spark, base, "history", mark)]
        taken, records = cut_lineage(links), None
        if len(new) > 1:
            asked = allowed(candidates(taken, parse_responses(landed.where(F.col("run_date").isin(new)))), params)
            records = page_records(asked.select("url"), pages)
        for run_date, mark in runs:
            _run(spark, base, run_date, mark, landed.where(F.col("run_date") == run_date), pages, taken, scorer, params, summarise, records)
    return run_batch


def _run(spark: SparkSession, base: str, run_date: str, mark: str, found: DataFrame, pages: DataFrame, links: DataFrame, scorer, params: CurateParams,
         summarise: Callable | None, records: DataFrame | None = None) -> None:
    inputs = links.select(F.col("source_url").alias("source_input")).unionByName(found.select(F.concat(F.lit("search:"), "term").alias("source_input")))
    now = datetime.now(UTC).isoformat(timespec="seconds")
    if not ST.published(spark, base, "history", mark):
        history = read_version(spark, f"{base}/history", ST.HISTORY_SCHEMA)
        chosen, _, _ = curate(candidates(links, parse_responses(found)), pages, history, scorer, replace(params, run_date=run_date), records)
        rows = cut_lineage(chosen.withColumn("last_included", F.lit(run_date)).select(*ST.ARTICLE_COLUMNS, "rank"))
        ST.publish_run(spark, base, rows, run_date, now, inputs, _overview(rows, run_date, summarise), mark)
    elif not ST.published(spark, base, "index", mark):
        rows = ST.read_daily(spark, f"{base}/daily", run_date)
        ST.publish_index(spark, base, rows, run_date, now, inputs, _overview(rows, run_date, summarise), mark)


def _overview(rows: DataFrame, run_date: str, summarise: Callable | None) -> str | None:
    """The run's one overview, from at most 20 selected rows; null if there are none or the function fails."""
    if summarise is None:
        return None
    got = overview_with(rows.withColumn("run_date", F.lit(run_date)), summarise).select("overview").first()
    return got.overview if got else None
