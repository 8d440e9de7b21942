"""URL filtering: fixed host and path rules first, mined association rules for the rest.

Association rules: the labelled URLs that no fixed rule fits are transactions
of URL tokens plus, for bad ones, a verdict item. FP-growth finds the frequent
combinations; those that imply the verdict item with enough support and
confidence become rules. They are matched through an inverted index: each
rule is filed under its rarest token, a URL looks up its own tokens, and only
the rules found there are compared in full. URLs with the same tokens are
looked up once.

A URL is labelled where the page's id has a row in ``labels``: bad if toxic or
of quality 0. URLs that a fixed rule judges teach nothing, as the mined rules
never judge their like.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Fixed rules of the query: verdict, host and path.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
BLOCK = "=block"
#: Blocked transactions that a mined rule has at least, however few are known.
MIN_ROWS = 5


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the host or a domain above it and begins the path; else null."""
    rule, verdict = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for v, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, rest = text.partition("/")
        fits = ((host_col == domain) | host_col.endswith("." + domain)) & path_col.startswith("/" + rest)
        rule, verdict = rule.when(fits, text), verdict.when(fits, v)
    return rule, verdict


def tokens(url: Column, host_col: Column, path_col: Column) -> Column:
    """Distinct sorted tokens: host labels and their parts, path segments with digits masked, query keys."""
    masked = F.regexp_replace(F.lower(path_col), "[0-9]+", "0")
    labels = F.split(host_col, r"\.")
    named = lambda kind, a: F.transform(F.filter(a, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(F.lower(x), "=", 1))
    return F.array_sort(F.array_distinct(F.concat(
        named("host:", labels), named("word:", F.split(host_col, "[.-]")), named("top:", F.slice(labels, -1, 1)),
        named("path:", F.split(masked, "/")), named("key:", F.coalesce(keys, F.array().cast("array<string>"))))))


def mine(known: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """(items, confidence, support, anchor) of the rules items -> block, from ``known`` (tokens, blocked).

    A rule's support is at least ``min_support`` of the rows and at least MIN_ROWS of them.
    """
    basket = known.where("size(tokens) > 0").select(F.when(F.col("blocked"), F.concat("tokens", F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    total = basket.count()
    if total < MIN_ROWS:
        return known.sparkSession.createDataFrame([], "items array<string>, confidence double, support long, anchor string")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (MIN_ROWS - 0.5) / total)).fit(basket)
    sets = materialise(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n")))
    blocked = sets.where(F.array_contains("items", BLOCK) & (F.size("items") > 1)).select(F.array_remove("items", BLOCK).alias("items"), F.col("n").alias("support"))
    rules = blocked.join(sets, "items").withColumn("confidence", F.col("support") / F.col("n")).where(F.col("confidence") >= min_confidence)
    single = sets.where("size(items) = 1").select(F.col("items")[0].alias("item"), F.col("n").alias("rows"))
    rarest = (rules.select("items", F.explode("items").alias("item")).join(single, "item")
              .groupBy("items").agg(F.min(F.struct("rows", "item")).alias("least")).select("items", F.col("least.item").alias("anchor")))
    return materialise(rules.join(rarest, "items").select("items", "confidence", "support", "anchor"))


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined, confidence): for each token set that a rule fits, the surest rule (ties: more support, then text)."""
    looked = token_sets.select("tokens", F.explode("tokens").alias("anchor")).join(rules, "anchor")
    fits = looked.where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.array_join("items", " ").alias("mined")))
    return fits.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))


def filter_urls(pages: DataFrame, labels: DataFrame, fixed=RULES, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence of every row of ``pages``.

    A null or malformed url has empty host and path; no rule can block it, so
    it is allowed. Repeated rows are judged alike and all returned; other
    columns are ignored. Without labelled pages beyond the fixed rules nothing
    is mined.
    """
    h, p = host(F.col("url")), path(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), fixed)
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), "url").withColumns({"host": h, "path": p})
            .withColumns({"rule": rule, "fixed": verdict, "tokens": tokens(F.col("url"), F.col("host"), F.col("path"))}).drop("url"))
    rows = materialise(rows)
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id"))
             .agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad")))
    known = rows.where("fixed is null").join(marks, "page_id").select("tokens", F.col("bad").alias("blocked"))
    rules = mine(known, min_support, min_confidence)
    open_sets = rows.where("fixed is null").select("tokens").distinct()
    found = match(open_sets, rules)
    hit = F.col("fixed").isNull() & F.col("mined").isNotNull()
    return rows.join(found, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("fixed", F.when(hit, "block").otherwise("allow")).alias("verdict"),
        F.when(hit, F.col("mined")).alias("mined"), F.when(hit, F.col("confidence")).alias("confidence"))
