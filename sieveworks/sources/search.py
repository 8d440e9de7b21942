"""Search-provider response payloads -> ordered result URLs.

Landing table: (provider, term_pos, term, payload JSON). Each provider has
its own payload shape; one ``CASE provider`` picks the parser. An unknown
provider fails the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUPPORTED_PROVIDERS = ["bing", "serpapi", "tavily"]

BING_SCHEMA = "struct<webPages: struct<value: array<struct<url: string>>>>"
SERP_SCHEMA = "struct<organic_results: array<struct<link: string, url: string>>>"
TAVILY_SCHEMA = "struct<results: array<struct<url: string>>>"


def resolve_provider(p) -> F.Column:
    c = F.lower(F.trim(F.col(p) if isinstance(p, str) else p))
    return F.when(c.isin(*SUPPORTED_PROVIDERS), c)


def _nonempty(c):
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def result_urls(provider, payload) -> F.Column:
    """array<string> of result URLs in response order (empty ones dropped)."""
    pr = resolve_provider(provider)
    p = F.col(payload) if isinstance(payload, str) else payload
    bing = F.transform(F.from_json(p, BING_SCHEMA)["webPages"]["value"], lambda x: _nonempty(x["url"]))
    serp = F.transform(F.from_json(p, SERP_SCHEMA)["organic_results"],
                       lambda x: F.coalesce(_nonempty(x["link"]), _nonempty(x["url"])))
    tav = F.transform(F.from_json(p, TAVILY_SCHEMA)["results"], lambda x: _nonempty(x["url"]))
    urls = F.when(pr == "bing", bing).when(pr == "serpapi", serp).when(pr == "tavily", tav)
    return F.filter(F.coalesce(urls, F.array().cast("array<string>")), lambda u: u.isNotNull())


def parse_responses(landing: DataFrame) -> DataFrame:
    """(provider, term_pos, term, result_pos, url) for every result; an unsupported provider raises."""
    known = F.coalesce(resolve_provider("provider"), F.raise_error(F.concat(
        F.lit("unsupported search provider: "), F.coalesce("provider", F.lit("null")))))
    rows = landing.withColumn("provider", known)
    return rows.select("provider", "term_pos", "term",
                       F.posexplode(result_urls(F.col("provider"), F.col("payload"))).alias("result_pos", "url"))


def first_wins(results: DataFrame, max_results: int = 20) -> DataFrame:
    """Per provider and term keep the first ``max_results`` results; a URL belongs to the
    first (term_pos, result_pos) that returned it. Both windows are
    ``row_number() <= k`` filters (partial group limit before the shuffle)."""
    per_term = (results.withColumn("_r", F.row_number().over(
        Window.partitionBy("provider", "term_pos").orderBy("result_pos"))).where(F.col("_r") <= max_results).drop("_r"))
    w = Window.partitionBy("url").orderBy("term_pos", "provider", "result_pos")
    return per_term.withColumn("_f", F.row_number().over(w)).where(F.col("_f") == 1).drop("_f")
