"""Reader-facing views over the daily and run-index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..functions.urls import absolute_url, form_encode, url_host
from .annotate import OVERVIEW_MAX_ITEMS, Answer, ask

# --- fixed values that must equal the reference -----------------------------
FACET_ORDER = ["all", "research", "blog", "news", "tutorial", "opinion", "other"]
UNTITLED, UNKNOWN_AUTHOR, NO_SUMMARY, NO_DATE = "Untitled", "Unknown author", "No summary available.", "No date"
OG_MAX_CHARS = 200
# -----------------------------------------------------------------------------


def _nz(c):
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def category_key(c="category") -> F.Column:
    return F.lower(F.coalesce(_nz(F.col(c)), F.lit("other")))


def facets(daily: DataFrame) -> DataFrame:
    """Per run_date: count per known category plus 'all' (unknown categories
    count only in 'all'); zero counts are absent; display position attached."""
    k = daily.withColumn("cat", category_key())
    g = k.rollup("run_date", "cat").agg(F.count(F.lit(1)).alias("n")).where(F.col("run_date").isNotNull())
    g = g.withColumn("facet", F.coalesce(F.col("cat"), F.lit("all")))
    order = F.array_position(F.array(*[F.lit(x) for x in FACET_ORDER]), F.col("facet"))
    return g.where(order > 0).select("run_date", "facet", F.col("n").cast("bigint").alias("n"),
                                     order.cast("int").alias("position"))


def filter_category(daily: DataFrame, category: str) -> DataFrame:
    if category == "all":
        return daily
    return daily.where(category_key() == F.lit(category))


def html_escape(c) -> F.Column:
    x = F.col(c) if isinstance(c, str) else c
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def percent_encode(c) -> F.Column:
    """UTF-8 percent encoding of a URL parameter; a space is %20."""
    return F.replace(form_encode(c), F.lit("+"), F.lit("%20"))


def cards(daily: DataFrame, base_url: str = "") -> DataFrame:
    """Display fields for each row: title, author, summary, date + discovered
    flag, score text and bar widths, favicon, page and share URLs.

    The score's two decimals round the binary value, a tie to even. The
    index's bar is the score in percent within 2 to 100, the page's is whole
    percents (a tie to even). Favicons go by host without ``www.`` (empty
    without a host); the share URL names the run's page, empty without one.
    """
    pub = _nz(F.col("published_at"))
    date = F.coalesce(pub, _nz(F.col("first_seen")), F.lit(NO_DATE))
    score = F.coalesce(F.col("relevance_score"), F.lit(0.0))
    host = url_host(F.col("url"))
    page = absolute_url(F.concat(F.lit("newsletter-"), F.col("run_date").cast("string"), F.lit(".html")), F.lit(base_url))
    return daily.select(
        "run_date", "url",
        html_escape(F.coalesce(_nz(F.col("title")), F.lit(UNTITLED))).alias("title_html"),
        F.coalesce(_nz(F.col("author")), F.lit(UNKNOWN_AUTHOR)).alias("author_text"),
        F.coalesce(_nz(F.col("summary")), F.lit(NO_SUMMARY)).alias("summary_text"),
        date.alias("date_text"), (pub.isNull() & _nz(F.col("first_seen")).isNotNull()).alias("discovered"),
        F.replace(F.format_number(score, 2), F.lit(","), F.lit("")).alias("score_text"),
        F.greatest(F.least(score * 100, F.lit(100.0)), F.lit(2.0)).alias("bar_index"),
        F.bround(score * 100).alias("bar_page"),
        F.when(host == "", F.lit("")).otherwise(F.concat(F.lit("https://www.google.com/s2/favicons?domain="), percent_encode(host), F.lit("&sz=32"))).alias("favicon"),
        page.alias("page_url"),
        F.when(page == "", F.lit("")).otherwise(F.concat(F.lit("https://www.linkedin.com/sharing/share-offsite/?url="), percent_encode(page))).alias("share_url"))


def og_description(overview, author_name: str) -> F.Column:
    base = F.replace(strip_ws(F.coalesce(F.col(overview) if isinstance(overview, str) else overview, F.lit(""))),
                     F.lit("\n"), F.lit(" "))
    base = F.when(F.length(base) > OG_MAX_CHARS,
                  F.concat(F.regexp_replace(F.substring(base, 1, OG_MAX_CHARS - 1), r"\s+$", ""), F.lit("…"))).otherwise(base)
    if not author_name:
        return base
    short = author_name.split(",")[0].strip()
    return F.regexp_replace(F.concat(base, F.lit(f" — Curated by {short}")), "^[ —]+|[ —]+$", "")


def runs_view(index: DataFrame, brand: str, author_name: str) -> DataFrame:
    """Per run: subject line, filename, social description, newest first."""
    n = F.col("count")
    label = F.when(n == 1, F.lit("article")).otherwise(F.lit("articles"))
    return index.select(
        "run_date", "count",
        F.format_string("%s · %s · %d %s", F.lit(brand), F.col("run_date").cast("string"), n, label).alias("subject"),
        F.concat(F.lit("newsletter-"), F.col("run_date").cast("string"), F.lit(".html")).alias("filename"),
        og_description("overview", author_name).alias("og_description"))


def timeline(index: DataFrame) -> DataFrame:
    """Runs newest first with long/short labels and a default-episode flag."""
    d = F.col("run_date").cast("date")
    w = Window.orderBy(F.col("run_date").desc())   # index has one row per run: small by construction
    return index.select("run_date", F.date_format(d, "EEEE, MMMM d, yyyy").alias("label_long"),
                        F.date_format(d, "MMM d").alias("label_short")) \
        .withColumn("position", F.row_number().over(w)).withColumn("is_default", F.col("position") == 1)


def overview_input(selected: DataFrame) -> DataFrame:
    """Per run_date: first 20 selected rows as '- title\\n  summary' bullets
    joined by a blank line (the overview request body)."""
    line = F.concat(F.lit("- "), strip_ws(F.coalesce(_nz(F.col("title")), F.lit(UNTITLED))), F.lit("\n  "),
                    strip_ws(F.coalesce(F.col("summary"), F.lit(""))))
    top = selected.where(F.col("rank") <= OVERVIEW_MAX_ITEMS)
    g = top.groupBy("run_date").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("l")))).alias("xs"))
    return g.select("run_date", F.array_join(F.transform("xs", lambda x: x["l"]), "\n\n").alias("body"))


def overview_with(selected: DataFrame, make: Callable[[], Answer]) -> DataFrame:
    """(run_date, overview, overview_error) per run: the user's function is asked once a run, with the request text.

    A run whose function raises has a null overview and the reason, as it goes
    on without one; an empty answer is null too.
    """
    asked = overview_input(selected).select("run_date", ask(F.col("body"), make).alias("a"))
    return asked.select("run_date", _nz(strip_ws(F.col("a.answer"))).alias("overview"), F.col("a.error").alias("overview_error"))


def digest_text(selected: DataFrame, overview: DataFrame, brand: str) -> DataFrame:
    """Plain-text digest per run_date (header, count, overview, articles)."""
    item = F.concat(F.lit("• "), strip_ws(F.coalesce(_nz(F.col("title")), F.lit(UNTITLED))), F.lit("\n  "), F.col("url"),
                    F.when(strip_ws(F.coalesce(F.col("summary"), F.lit(""))) != "",
                           F.concat(F.lit("\n  "), strip_ws(F.col("summary")))).otherwise(F.lit("")), F.lit("\n"))
    g = selected.groupBy("run_date").agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("t")))).alias("xs"),
                                         F.count(F.lit(1)).alias("n"))
    g = g.join(overview.select("run_date", "overview"), "run_date", "left")
    head = F.concat(F.lit(brand + " — "), F.col("run_date").cast("string"), F.lit("\n"), F.col("n").cast("string"),
                    F.when(F.col("n") == 1, F.lit(" article")).otherwise(F.lit(" articles")), F.lit("\n\n"),
                    F.when(F.coalesce(F.col("overview"), F.lit("")) != "", F.concat(F.col("overview"), F.lit("\n\n")))
                    .otherwise(F.lit("")))
    return g.select("run_date", F.concat(head, F.array_join(F.transform("xs", lambda x: x["t"]), "\n")).alias("text"))
