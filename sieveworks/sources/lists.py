"""Text-list sources: search terms, source URLs, domain lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip_ws
from ..session import cut_lineage


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line): the lines of a text file, or of a folder's files by name, with their number from 0.

    The numbers are exact and gapless, whatever the number of files and
    splits: each split's lines are counted, a running sum over the splits in
    order gives where each begins, and a line adds its place in its split. Only
    the counts, one row a split, meet in one task.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = cut_lineage(spark.read.text(path).select(*place, F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")))
    splits = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))  # ids run on within a split
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return lines.join(begins, ["file", "block"]).select((F.col("begin") + F.col("id") - F.col("first")).alias("pos"), "line")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """(pos, term): stripped, blanks dropped, order and duplicates kept, no
    comment syntax. A missing file raises."""
    lines = _lines(spark, path).select("pos", strip_ws(F.col("line")).alias("term"))
    return lines.where(F.col("term") != "")


def load_url_list(spark: SparkSession, path: str | None, extra: list[str] | None = None) -> DataFrame:
    """Distinct source URLs: file lines (stripped, non-blank) union extras."""
    parts = []
    if path:
        parts.append(spark.read.text(path).select(strip_ws(F.col("value")).alias("url")).where(F.col("url") != ""))
    if extra:
        parts.append(spark.createDataFrame([(u,) for u in extra], "url string"))
    if not parts:
        return spark.createDataFrame([], "url string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def load_domains(spark: SparkSession, path: str) -> DataFrame:
    """(pos, domain): stripped, blanks and '#' lines dropped, lower-cased.
    A missing file yields an empty list."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("pos", T.LongType()),
                                                       T.StructField("domain", T.StringType())]))
    s = _lines(spark, path).select("pos", strip_ws(F.col("line")).alias("d"))
    return s.where((F.col("d") != "") & ~F.col("d").startswith("#")).select("pos", F.lower("d").alias("domain"))


def run_sources(source_urls: DataFrame, terms: DataFrame) -> DataFrame:
    """The run's inputs, a row each: (kind, pos, source_input) with the distinct
    source URLs (kind 0, in URL order) before 'search:' + term (kind 1, by pos)."""
    urls = source_urls.select(F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("pos"), F.col("url").alias("source_input")).distinct()
    found = terms.select(F.lit(1).alias("kind"), F.col("pos").cast("bigint").alias("pos"), F.concat(F.lit("search:"), "term").alias("source_input"))
    return urls.unionByName(found)
