"""Candidate URLs of a run: harvested links and search hits, first writer wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import exclude_domains, restrict_domains

# Hosts that search results leave out unless told otherwise.
DEFAULT_EXCLUDE_DOMAINS = [
    "betterprogramming.pub",
    "levelup.gitconnected.com",
    "medium.com",
    "pub.towardsai.net",
    "towardsdatascience.com",
]


def harvested(sources: DataFrame, links: DataFrame) -> DataFrame:
    """(source_url, url): the links of each source page, or the page itself if it has none."""
    got = links.select("source_url", "url").where("url is not null").distinct()
    none = sources.select("source_url").distinct().join(got.select("source_url").distinct(), "source_url", "left_anti")
    return got.unionByName(none.select("source_url", F.col("source_url").alias("url")))


def search_hits(hits: DataFrame, excluded=None, preferred=None, mode: str = "off", provider: str | None = None) -> DataFrame:
    """(term, term_pos, result_pos, url) after the excluded and, in strict mode, the listed domains."""
    out = hits.select("term", "term_pos", "result_pos", "url")
    drop = DEFAULT_EXCLUDE_DOMAINS if excluded is None else excluded
    if isinstance(drop, DataFrame) or drop:
        out = exclude_domains(out, "url", drop)
    return restrict_domains(out, "url", preferred or [], provider) if mode == "strict" else out


def candidates(source_links: DataFrame, hits: DataFrame) -> DataFrame:
    """(url, provenance, kind, src, pos): one row per URL, from its first writer.

    Source pages (kind 0, in URL order) come before search hits (kind 1, by
    term and result position). Provenance is the source page or the term.
    """
    schema = [F.col("url"), F.col("provenance"), F.col("kind"), F.col("src"), F.col("pos")]
    links = source_links.select("url", F.col("source_url").alias("provenance"), F.lit(0).alias("kind"),
                                F.col("source_url").alias("src"), F.lit(0).cast("bigint").alias("pos")).select(*schema)
    found = hits.select("url", F.col("term").alias("provenance"), F.lit(1).alias("kind"),
                        F.lpad(F.col("term_pos").cast("string"), 19, "0").alias("src"), F.col("result_pos").cast("bigint").alias("pos"))
    first = F.min(F.struct("kind", "src", "pos", "provenance")).alias("f")
    return links.unionByName(found).where("url is not null").groupBy("url").agg(first).select("url", "f.provenance", "f.kind", "f.src", "f.pos")


def check_inputs(sources: DataFrame, terms: DataFrame) -> None:
    """A run needs a source page or a search term."""
    if sources.isEmpty() and terms.isEmpty():
        raise ValueError("a run needs source URLs or search terms")
