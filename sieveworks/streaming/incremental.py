"""Incremental curation over a file stream.

New landing files -> ``readStream`` (file source) -> ``foreachBatch``: the rows
of each run date are deduplicated against the history's window on
``last_included`` (cross-run state is a table, not operator state: only
selected rows enter it) and within themselves; the kept rows are selected from
and those selected go to history and to its signature index under their run
date, so a run joins its own band rows with the window's folders of the index
and history is neither exploded nor shuffled again. Both writes are idempotent
per batch id (dynamic overwrite of the partitions of that batch and date), so
a batch replayed after a failure, between the two or elsewhere, rewrites and
does not double.

A landing file's rows carry their run date (``run_date``, yyyy-MM-dd). A batch
takes all files that have arrived unless ``max_files`` limits it, and its run
dates are taken in ascending order, so what arrives together gives the same as
one arrival a date. Within a date the order is by id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import minhash as M
from ..operators import dedup as D
from ..operators.sig_index import SignatureIndex
from ..session import cut_lineage
from ..sources.lists import path_exists


STATE_SCHEMA = "id bigint, sig array<bigint>, last_included string, batch_id bigint"


def _process(history_path: str, index: SignatureIndex, days: int, select: Callable[[DataFrame], DataFrame] | None):
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = f"{history_path}-batches/batch_id={batch_id}"  # a folder a date, so that a run reads its own rows alone
        batch.withColumn("sig", M.signature("text")).drop("text").write.mode("overwrite").option("partitionOverwriteMode", "static") \
            .partitionBy("run_date").parquet(path)
        dates = _run_dates(batch)
        schema = batch.withColumn("sig", M.signature("text")).drop("text").schema
        for run_date in dates:
            today = spark.read.schema(schema).parquet(path).where(F.col("run_date") == run_date)
            fresh = today.select(F.col("doc_id").alias("id"), "sig", F.lit("").alias("title_key"))
            cutoff = str(date.fromisoformat(run_date) - timedelta(days=days))
            # A replayed batch does not meet what it wrote the time before.
            own = (F.col("batch_id") == batch_id) & (F.col("last_included") >= run_date)
            fresh = cut_lineage(index.anti(fresh, "id", "sig", cutoff, own))
            kept = today.join(D.greedy_dedup(fresh).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
            out = cut_lineage((select(kept) if select else kept).select(
                F.col("doc_id").alias("id"), "sig", F.col("run_date").alias("last_included"), F.lit(batch_id).cast("bigint").alias("batch_id")))
            (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id", "last_included").parquet(history_path))
            index.add(out)
    return run_batch


def _run_dates(rows: DataFrame) -> list[str]:
    """The distinct run dates in order, one a run; a row without one is an error."""
    dates = [r.run_date for r in rows.select("run_date").distinct().collect()]
    if None in dates:
        raise ValueError("every landing row needs a run_date")
    return sorted(dates)


def run_incremental(spark: SparkSession, docs: DataFrame, base: str, days: int = 60,
                    select: Callable[[DataFrame], DataFrame] | None = None, max_files: int | None = None) -> DataFrame:
    """(doc_id, batch_id) of the rows selected from ``docs`` (doc_id, text, run_date, ...), landed under ``base`` one run date after the other.

    ``select`` chooses among a run's kept rows (all columns but text, and sig); without it all are selected.
    ``max_files``: files per micro-batch.
    """
    landing, history, ckpt = f"{base}/landing", f"{base}/history", f"{base}/_checkpoint"
    dates = _run_dates(docs)
    docs.write.partitionBy("run_date").parquet(f"{base}/arrivals")  # read once, whatever the number of dates
    index = SignatureIndex(spark, f"{base}/index")
    for run_date in dates:
        spark.read.schema(docs.schema).parquet(f"{base}/arrivals").where(F.col("run_date") == run_date).write.mode("append").parquet(landing)
        source = spark.readStream.schema(docs.schema)
        if max_files:
            source = source.option("maxFilesPerTrigger", max_files)
        q = (source.parquet(landing).writeStream.foreachBatch(_process(history, index, days, select))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
    if not path_exists(spark, history):
        return spark.createDataFrame([], "doc_id bigint, batch_id bigint")
    return spark.read.schema(STATE_SCHEMA).parquet(history).select(F.col("id").alias("doc_id"), "batch_id")
