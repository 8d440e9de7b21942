"""Domain allow / block / boost policies.

A host matches a domain when it equals it or ends with '.' + domain (one
leading 'www.' removed on both sides). The suffix test is turned into an
equi-join: each host expands to its label-boundary suffixes
('a.b.c' -> 'a.b.c', 'b.c', 'c') which join the domain list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import host_suffixes, url_host

def clean_domains(domains) -> list[str]:
    out = []
    for d in domains or []:
        d = d.strip().lower()
        out.append(d[4:] if d.startswith("www.") else d)
    return out


def in_domains_col(url, domains: list[str]) -> F.Column:
    """Boolean Column for a literal (config-sized) domain list; no join."""
    doms = clean_domains(domains)
    if not doms:
        return F.lit(False)
    arr = F.array(*[F.lit(d) for d in doms])
    u = F.col(url) if isinstance(url, str) else url
    return F.exists(host_suffixes(url_host(u)), lambda s: F.array_contains(arr, s))


def flag_in_domains(df: DataFrame, url: str, domains, flag: str = "in_list") -> DataFrame:
    """Add a boolean ``flag``; ``domains`` is a Python list or a one-column
    DataFrame (``domain``) of any size."""
    if not isinstance(domains, DataFrame):
        return df.withColumn(flag, in_domains_col(url, domains))
    dom = (domains.select(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", "").alias("suffix"))
           .where(F.col("suffix") != "").distinct())
    keyed = df.withColumn("_host", F.coalesce(url_host(F.col(url)), F.lit("")))
    # Each distinct host once, so a suffix such as 'com' meets hosts and not rows.
    hosts = keyed.select("_host").distinct()
    hits = (hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("suffix"))
            .join(dom, "suffix", "left_semi").select("_host").distinct().withColumn("_hit", F.lit(True)))
    return keyed.join(hits, "_host", "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_host", "_hit")


def exclude_domains(df: DataFrame, url: str, domains) -> DataFrame:
    """Drop rows on excluded domains (applies in every domain mode)."""
    return flag_in_domains(df, url, domains, "_excl").where(~F.col("_excl")).drop("_excl")


def restrict_domains(df: DataFrame, url: str, domains, provider: str | None = None,
                     honoured_by=("tavily",)) -> DataFrame:
    """Strict mode: keep only rows on listed domains. ``honoured_by``
    reproduces providers that silently ignore the include list."""
    if provider is not None and provider not in honoured_by:
        return df
    return flag_in_domains(df, url, domains, "_incl").where(F.col("_incl")).drop("_incl")


def effective_score(df: DataFrame, url: str, score: str, domains, boost: float,
                    out: str = "eff_score") -> DataFrame:
    """score * boost for rows on preferred domains (not clamped)."""
    flagged = flag_in_domains(df, url, domains, "preferred")
    return flagged.withColumn(out, F.when(F.col("preferred"), F.col(score) * F.lit(boost)).otherwise(F.col(score)))
