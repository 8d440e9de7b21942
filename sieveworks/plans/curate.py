"""The curation run as one composed DataFrame plan.

candidates (domain policy on search hits first) -> URL anti join vs history window -> page lookup -> article
fields -> title / near-dup anti joins vs history -> exact in-run greedy dedup
-> annotation -> domain policy -> capped top-k. Pure DataFrames in and out;
sinks are separate (operators.store).

Order follows cost: the URL anti join runs before the page join, which is an
inner join on keys with the few fresh URLs as the small side, so only their
html moves; it is dropped right after extraction. The candidates that found
no page come back from the keys for the audit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import minhash as M
from ..functions.text import normalize_title
from ..functions.urls import canon_fetch_url, normalize_url, url_host
from ..operators import dedup as D
from ..operators import policy as P
from ..operators.annotate import annotated
from ..operators.pages import PageTable
from ..operators.rank import select_top
from ..session import cut_lineage


@dataclass
class CurateParams:
    run_date: str
    dedup_days: int = 60
    url_key: str = "raw"               # 'raw' (reference behaviour) or 'normalized'
    max_articles: int = 10
    max_per_domain: int | None = 2
    min_articles: int = 3
    domain_mode: str = "boost"         # off | strict | boost
    domain_boost: float = 1.3
    preferred_domains: list[str] = field(default_factory=list)
    exclude_domains: list[str] = field(default_factory=list)
    search_provider: str | None = None  # strict mode holds for providers that honour it (None: all)
    threshold: float = M.DEFAULT_THRESHOLD


def _key(c, mode: str):
    return normalize_url(c) if mode == "normalized" else c


def page_lookup(wanted: DataFrame, pages: DataFrame | PageTable) -> DataFrame:
    """``wanted`` (with _page_url) with the html of its page; rows whose page is missing or empty go.

    Of several snapshots of one URL the smallest page_id counts. A published
    ``PageTable`` is asked for the wanted pages alone. Any other frame of
    snapshots (url, page_id, html) is scanned, as its html has to be seen to
    know that it is not empty; pages that nobody wants are filtered by the
    join with the wanted keys before html is shuffled.
    """
    if isinstance(pages, PageTable):
        return wanted.join(pages.lookup(wanted), "_page_url").drop("_page_url")
    keys = wanted.select("_page_url").distinct()
    snap = pages.select(F.col("url").alias("_page_url"), "page_id", "html").where(F.coalesce("html", F.lit("")) != "").join(keys, "_page_url", "left_semi")
    one = snap.groupBy("_page_url").agg(F.min_by("html", "page_id").alias("html"))
    return wanted.join(one, "_page_url").drop("_page_url")


def allowed(candidates: DataFrame, params: CurateParams) -> DataFrame:
    """(url, source_url): a row a URL key, from its first writer, after the domain policy on search hits."""
    hit = F.col("kind") == 1
    found = candidates.where(hit)
    if params.exclude_domains:
        found = P.exclude_domains(found, "url", params.exclude_domains)
    if params.domain_mode == "strict":
        found = P.restrict_domains(found, "url", params.preferred_domains, params.search_provider)
    return (candidates.where(~hit).unionByName(found)
            .withColumn("url", _key(F.col("url"), params.url_key)).where(F.col("url").isNotNull())
            .groupBy("url").agg(F.min(F.struct("kind", "src", "pos", "provenance")).alias("f"))
            .select("url", F.col("f.provenance").alias("source_url")))


def page_records(wanted: DataFrame, pages: DataFrame | PageTable) -> DataFrame:
    """``wanted`` (with url) that have a page, with its article fields, title key and signature."""
    looked = page_lookup(wanted.withColumn("_page_url", canon_fetch_url(F.col("url"))), pages)
    recs = cut_lineage(H.extract_records(looked).drop("html"))
    return cut_lineage(recs.withColumn("title_key", normalize_title(F.col("title")))
                       .withColumn("sig", M.signature(F.col("content"))))


def curate(candidates: DataFrame, pages: DataFrame | PageTable, history: DataFrame, scorer, params: CurateParams,
           records: DataFrame | None = None):
    """Returns (selected, audit, run_row).

    candidates: (url, provenance, kind, src, pos), see operators.candidates;
    pages: (url, page_id, html) or a published page table; history: article rows; scorer: DataFrame -> DataFrame
    adding summary/category/relevance_score/tags/takeaways (rows it drops
    count as failed annotations); records: ``page_records`` of all distinct URLs
    that ``allowed`` gives, where several runs over the same pages share them. No candidate at all is an error.
    """
    spec = D.SimSpec(params.threshold)
    cands = cut_lineage(allowed(candidates, params))
    if cands.isEmpty():
        raise ValueError("a run needs source URLs or search terms")

    window = cut_lineage(D.hist_window(history, params.run_date, params.dedup_days).select("url", "title", "minhash"))
    seen_urls = window.select(_key(F.col("url"), params.url_key).alias("url")).where(F.col("url").isNotNull())
    seen_urls, seen_titles, seen_sigs = D.hist_keys(window.withColumn("url", _key(F.col("url"), params.url_key)),
                                                    normalize_title)

    fresh = cut_lineage(D.anti_url(cands, seen_urls, "url"))
    recs = page_records(fresh, pages) if records is None else cut_lineage(fresh.join(records, "url"))

    after_title = D.anti_title(recs, seen_titles, "title_key")
    after_near = cut_lineage(D.anti_neardup(after_title, seen_sigs, "url", "sig", spec).select("url", "title_key", "sig"))
    scan = D.ordered_scan(after_near, "url", "title_key", "sig", spec)
    kept = recs.join(scan.kept.select(F.col("id").alias("url")), "url", "left_semi")

    answered = cut_lineage(annotated(kept.transform(scorer)).drop("annotation_error"))  # a scorer may cost: once a row
    articles = answered.withColumn("first_seen", F.lit(params.run_date)).withColumn(
        "last_included", F.lit(None).cast("string"))
    boost_list = params.preferred_domains if params.domain_mode == "boost" else []
    scored = P.effective_score(articles, "url", "relevance_score", boost_list, params.domain_boost)
    selected = select_top(scored.withColumn("host", url_host(F.col("url"))), params.max_articles,
                          params.max_per_domain, "eff_score", "relevance_score")
    selected = selected.withColumn("run_date", F.lit(params.run_date)).withColumnRenamed("sig", "minhash")

    has_page = recs.select("url", F.lit(True).alias("has_page"))
    audit = dedup_audit(cands, seen_urls, has_page, recs, seen_titles, scan, answered.select("url"))
    run_row = selected.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(params.run_date).alias("run_date"), F.col("count").cast("bigint").alias("count"),
        (F.col("count") < params.min_articles).alias("thin_run"))
    return selected, audit, run_row


def dedup_audit(cands, seen_urls, looked, recs, seen_titles, scan: D.Scan, answered) -> DataFrame:
    """Reason per candidate: seen_url, no_page, dup_title, near_dup, kept or
    annotation_failed (kept by dedup, but without an annotation), with the
    blocking row for in-run conflicts (title checked before similarity, as in
    the ordered scan). Rows that history dropped did not enter the scan; their
    titles are held against what it kept. Nothing is compared again."""
    seen = seen_urls.distinct().withColumn("_seen", F.lit(True))
    a = cands.select("url").join(seen, "url", "left").join(looked, "url", "left")
    hist_t = recs.join(seen_titles.select(F.col("title_key").alias("_t")).where(F.col("_t") != ""),
                       F.col("title_key") == F.col("_t"), "left_semi").select("url").withColumn("_ht", F.lit(True))
    scanned = scan.rows.select(F.col("id").alias("url"), F.lit(True).alias("_in"))
    other = recs.select(F.col("url").alias("id"), "title_key").join(scan.rows.select("id"), "id", "left_anti")
    blocks = D.blocking_rows(scan, other).withColumnRenamed("id", "url")
    a = (a.join(hist_t, "url", "left").join(scanned, "url", "left").join(blocks, "url", "left")
         .join(scan.kept.select(F.col("id").alias("url"), F.lit(True).alias("_k")), "url", "left")
         .join(answered.withColumn("_an", F.lit(True)), "url", "left"))
    reason = (F.when(F.col("_seen"), "seen_url")
               .when(~F.coalesce(F.col("has_page"), F.lit(False)), "no_page")
               .when(F.col("_k"), F.when(F.col("_an"), "kept").otherwise("annotation_failed"))
               .when(F.col("_ht") | F.col("t_block").isNotNull(), "dup_title")
               .otherwise("near_dup"))
    blocker = (F.when((reason == "dup_title") & ~F.coalesce(F.col("_ht"), F.lit(False)), F.col("t_block"))
                .when((reason == "near_dup") & F.col("_in"), F.col("s_block")))
    return a.select("url", reason.alias("reason"), blocker.alias("blocked_by"))
