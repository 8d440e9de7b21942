"""Signature index kept with the history.

Two tables, written once a run and never rewritten: ``bands`` holds a row per
band key of each selected signature (with its sketch), bucketed by the key, and ``sigs`` the
signatures, bucketed by their hash. Both are partitioned by the date of the
run and the batch that wrote them, so the dedup window prunes folders and a
replayed batch overwrites its own. A run shuffles only its own band rows: the
history side is read bucket by bucket, without exploding or exchanging it.

A row's date is that of the run that included it. Dates only grow (a URL of
the window is never a candidate again), so an article that comes back after
the window has a newer row, and its old one stays outside every later window.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.lists import path_exists
from .dedup import SimSpec, band_rows, candidate_pairs, sketch_columns, verified

PARTS = ["last_included", "batch_id"]


class SignatureIndex:
    """The index under ``path``; ``buckets`` is fixed when it is first made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, spec: SimSpec = SimSpec()):
        self.path, self.spec = path, spec
        tag = hashlib.sha1(path.encode()).hexdigest()[:16]
        self.bands, self.sigs = f"sig_bands_{tag}", f"sig_rows_{tag}"
        self.words = sketch_columns(spec)
        for name, columns, key in ((self.bands, ", ".join(f"{c} BIGINT" for c in ("id", "bkey", *self.words)), "bkey"), (self.sigs, "id BIGINT, sig ARRAY<BIGINT>", "id")):
            known = path_exists(spark, f"{path}/{name}")
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, last_included STRING, batch_id BIGINT) USING parquet "
                      f"PARTITIONED BY ({', '.join(PARTS)}) CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}/{name}'")
            if known:
                spark.sql(f"MSCK REPAIR TABLE {name}")

    def add(self, selected: DataFrame, sig_col: str = "sig") -> None:
        """Write the signatures of ``selected`` (with last_included and batch_id); what their date and batch held before is replaced."""
        rows = cut_lineage(selected.where(F.col(sig_col).isNotNull()).select(F.xxhash64(sig_col).alias("id"), F.col(sig_col).alias("sig"), *PARTS)
                           .dropDuplicates(["id", *PARTS]))
        marks = rows.select(*PARTS, "id", "sig")
        keys = band_rows(marks.select(F.struct(*PARTS, "id").alias("k"), "sig"), "k", "sig", self.spec)
        conf = rows.sparkSession.conf  # a stream's batches run in a session of their own
        mode = conf.get("spark.sql.sources.partitionOverwriteMode")
        conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            # One task a bucket, whatever the dates: no more files than buckets a date.
            keys.select("id.id", "bkey", *self.words, *[f"id.{p}" for p in PARTS]).repartition("bkey").write.insertInto(self.bands, overwrite=True)
            marks.select("id", "sig", *PARTS).repartition("id").write.insertInto(self.sigs, overwrite=True)
        finally:
            conf.set("spark.sql.sources.partitionOverwriteMode", mode)

    def hits(self, cands: DataFrame, id_col: str, sig_col: str, cutoff: str, but=None) -> DataFrame:
        """(l, r, agree): candidates and signatures of the window (last_included >= ``cutoff``, without rows for which ``but`` holds) that are near-duplicates."""
        window = F.col("last_included") >= cutoff
        window = window if but is None else window & ~but
        # A signature of several dates is one candidate.
        spark = cands.sparkSession
        bands = spark.table(self.bands).where(window).groupBy("bkey", "id").agg(*[F.first(k).alias(k) for k in self.words])
        sigs = spark.table(self.sigs).where(window).groupBy("id").agg(F.first("sig").alias("rs")).withColumnRenamed("id", "r")
        own = cut_lineage(cands.select(id_col, sig_col).where(F.col(sig_col).isNotNull()))
        pairs = candidate_pairs(band_rows(own, id_col, sig_col, self.spec), bands, self.spec)
        return verified(pairs, own.select(F.col(id_col).alias("l"), F.col(sig_col).alias("ls")), sigs, self.spec)

    def anti(self, cands: DataFrame, id_col: str, sig_col: str, cutoff: str, but=None) -> DataFrame:
        """Drop candidates that are near-duplicates of a signature of the window."""
        near = self.hits(cands, id_col, sig_col, cutoff, but).select(F.col("l").alias(id_col)).distinct()
        return cands.join(near, id_col, "left_anti")
