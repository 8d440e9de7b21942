"""A crawl table for lookups: html is read only near the pages that a run wants.

``publish_pages`` lays snapshots out in ``parts`` folders by a hash of the URL,
sorted by (url, page_id) within each file, with a Bloom filter on the URL.
``PageTable.lookup`` picks a snapshot by its key columns alone and reads html
for the picked rows: up to ``LITERAL_KEYS`` wanted URLs become filters that
prune folders, row groups and column pages in the scan; beyond that number the
same table is joined with the keys by a shuffle. The result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

LITERAL_KEYS = 2000  # wanted URLs that are collected, after they are counted, to become filters of the scan
ROW_GROUP_URLS = 5000  # URLs of a row group that its Bloom filter is laid out for (6 KB; without a number each takes 1 MB)
SCHEMA = "url string, page_id bigint, html string, part int"


def _part(url, parts: int) -> F.Column:
    return F.pmod(F.xxhash64(url), F.lit(parts)).cast("int")


def publish_pages(pages: DataFrame, path: str, parts: int = 1024, row_group_bytes: int = 16 << 20) -> "PageTable":
    """Write snapshots (url, page_id, html) for lookups; rows without url or html are none. Take ``parts`` so that a part
    holds some hundred MB. Rows are dealt by ranges of (part, url, page_id), so a URL with many snapshots is split."""
    rows = pages.where("url is not null and coalesce(html, '') <> ''").select("url", F.col("page_id").cast("bigint").alias("page_id"), "html", _part("url", parts).alias("part"))
    (rows.repartitionByRange("part", "url", "page_id").sortWithinPartitions("part", "url", "page_id")
     .write.option("parquet.bloom.filter.enabled#url", "true").option("parquet.bloom.filter.expected.ndv#url", ROW_GROUP_URLS)
     .option("parquet.block.size", row_group_bytes).partitionBy("part").parquet(path))
    return PageTable(pages.sparkSession, path, parts)


class PageTable:
    """The table at ``path``; ``parts`` as it was published."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 1024):
        self.spark, self.path, self.parts = spark, path, parts

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def lookup(self, wanted: DataFrame, key: str = "_page_url") -> DataFrame:
        """(key, html) of the wanted URLs that have a page: the snapshot of smallest page_id (of equal ids the smallest html)."""
        keys = cut_lineage(wanted.where(F.col(key).isNotNull()).select(F.col(key).alias("url")).distinct().withColumn("part", _part("url", self.parts)))
        few = keys.count() <= LITERAL_KEYS
        table = self._near(keys.collect()) if few else self.read().join(keys, ["part", "url"], "left_semi")
        first = cut_lineage(table.groupBy("part", "url").agg(F.min("page_id").alias("page_id")))
        if few:  # one row a wanted URL at most
            picked = first.collect()
            table = self._near(picked).where(F.col("page_id").isin([r.page_id for r in picked]))
        html = table.join(first, ["part", "url", "page_id"]).groupBy("url").agg(F.min("html").alias("html"))
        return html.withColumnRenamed("url", key)

    def _near(self, rows) -> DataFrame:
        return self.read().where(F.col("part").isin(sorted({r.part for r in rows})) & F.col("url").isin(sorted({r.url for r in rows})))
