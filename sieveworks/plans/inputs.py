"""Inputs derived from the test tables, defined once for Spark and for SQL.

Every derivation keeps whole tables: rows are split into roles (history vs
candidates) or re-shaped, never sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_DATE = "2024-06-01"
DEDUP_DAYS = 60
# Documents from these sources were published by earlier runs (history role).
HIST_SOURCES = ["src0", "src1"]
# Pages whose raw URL carries no query or fragment were published earlier;
# the tracking/fragment variants are today's candidates.
HIST_PAGE_PREDICATE_SQL = "NOT regexp_matches(url, '[?#]')"
# Domain policy lists used by the policy queries (hosts from the test crawl).
PREFERRED_DOMAINS = ["ththan.example.net", "www.therti.example.org", "example.com", "notx.example.org"]
EXCLUDE_DOMAINS = ["cheap-pills.example.com", "spam-farm.example.org"]
SEARCH_PROVIDERS = ["bing", "serpapi", "tavily"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; text tables in fewer splits than cores are spread out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def hist_docs(spark, sf_dir) -> DataFrame:
    """History rows made from documents of the published sources."""
    d = table(spark, sf_dir, "documents").where(F.col("source").isin(*HIST_SOURCES))
    last = F.date_format(F.date_sub(F.to_date(F.lit(RUN_DATE)), (F.col("n_chars") % 90).cast("int")), "yyyy-MM-dd")
    return d.select("doc_id", "text", F.col("doc_id").cast("string").alias("url"), last.alias("last_included"))


def new_docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").where(~F.col("source").isin(*HIST_SOURCES))


HIST_DOCS_SQL = (f"(SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS url, "
                 f"strftime(DATE '{RUN_DATE}' - CAST(n_chars % 90 AS INTEGER), '%Y-%m-%d') AS last_included "
                 f"FROM documents WHERE source IN ('src0', 'src1'))")
NEW_DOCS_SQL = "(SELECT * FROM documents WHERE source NOT IN ('src0', 'src1'))"


def split_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "pages")
    hist = ~F.col("url").rlike("[?#]")
    return p.where(hist), p.where(~hist)
