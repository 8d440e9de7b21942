"""Ranked top-k with a per-host diversity cap.

Rank order: effective score desc, published_at (or '') desc, first_seen (or
'') desc, url asc. Selection fills up to ``n`` rows taking at most
``max_per_domain`` per host in rank order, then tops up from the overflow in
rank order. Equivalent set form: first n rows ordered by
(host_rank > cap, rank order).

Plan: one window, ``row_number() <= cap + n`` per host, which Spark turns into
a WindowGroupLimit below the shuffle (a host holding a third of all rows sends
at most cap + n rows per map task; beyond them no row of a host can be
chosen), then one TakeOrderedAndProject over (beyond the cap, rank order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import url_host


def rank_order(score: str = "eff_score"):
    return [F.col(score).desc(), F.coalesce(F.col("published_at"), F.lit("")).desc(),
            F.coalesce(F.col("first_seen"), F.lit("")).desc(), F.col("url").asc()]


def select_top(df: DataFrame, n: int = 10, max_per_domain: int | None = 2, score: str = "eff_score",
               raw_score: str = "relevance_score") -> DataFrame:
    """Top ``n`` rows with ``rank`` 1..n and ``overflow`` flag. Rows with
    raw score <= 0 never qualify; n <= 0 selects nothing."""
    if n <= 0:
        return df.limit(0).withColumn("overflow", F.lit(False)).withColumn("rank", F.lit(0))
    base = df.where(F.col(raw_score) > 0)
    if "host" not in base.columns:
        base = base.withColumn("host", url_host(F.col("url")))
    order = rank_order(score)
    if max_per_domain and max_per_domain > 0:
        in_host = F.row_number().over(Window.partitionBy("host").orderBy(*order))
        base = (base.withColumn("_hr", in_host).where(F.col("_hr") <= max_per_domain + n)
                .withColumn("overflow", F.col("_hr") > max_per_domain).drop("_hr"))
    else:
        base = base.withColumn("overflow", F.lit(False))
    top = base.orderBy("overflow", *order).limit(n)
    rank_w = Window.orderBy(F.col("overflow").asc(), *order)   # <= n rows: one small task by design
    return top.withColumn("rank", F.row_number().over(rank_w))
