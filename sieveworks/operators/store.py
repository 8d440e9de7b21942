"""History, daily and run-index tables: upserts and sinks.

Upserts are full-outer joins on the key with per-column rules, committed as a
new version of the table (see ``versions``); the daily table is
partitioned by run_date and overwritten one partition at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.lists import path_exists
from .versions import current_version, read_version, version_mark, write_version

ARTICLE_COLUMNS = ["url", "title", "author", "published_at", "summary", "content", "category", "relevance_score",
                   "tags", "takeaways", "first_seen", "last_included", "source_url", "minhash"]
PUBLIC_DROP = ["content", "minhash"]


def record_defaults(df: DataFrame) -> DataFrame:
    """Defaults on read: missing category -> 'other', score -> 0.0, tags ->
    [] (only when the column is absent); takeaways null/empty -> []."""
    cols = df.columns
    def have(c, default):
        return F.col(c) if c in cols else default
    return df.select(
        *[have(c, F.lit(None).cast("string")).alias(c) for c in
          ["url", "title", "author", "published_at", "summary", "content"]],
        have("category", F.lit("other")).alias("category"),
        have("relevance_score", F.lit(0.0)).cast("double").alias("relevance_score"),
        have("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce(have("takeaways", F.lit(None).cast("array<string>")), F.array().cast("array<string>")).alias("takeaways"),
        *[have(c, F.lit(None).cast("string")).alias(c) for c in ["first_seen", "last_included", "source_url"]],
        have("minhash", F.lit(None).cast("array<bigint>")).alias("minhash"))


def upsert_history(history: DataFrame, selected: DataFrame, run_date: str) -> DataFrame:
    """Insert new URLs (first_seen = last_included = run_date); update known
    ones: overwrite content fields and score, last_included = run_date,
    takeaways new-if-non-empty else old else [], minhash new-if-not-null else
    old; url, first_seen and source_url kept. Untouched rows pass through."""
    h = history.select(*[F.col(c).alias("h_" + c) for c in ARTICLE_COLUMNS])
    n = selected.select(*[F.col(c).alias("n_" + c) for c in ARTICLE_COLUMNS])
    j = h.join(n, F.col("h_url") == F.col("n_url"), "full_outer")
    is_new, has_new = F.col("h_url").isNull(), F.col("n_url").isNotNull()
    d = F.lit(run_date)

    def pick(c):
        return F.when(has_new, F.col("n_" + c)).otherwise(F.col("h_" + c))
    empty = F.array().cast("array<string>")
    out = {
        "url": F.coalesce(F.col("h_url"), F.col("n_url")),
        "first_seen": F.when(is_new, d).otherwise(F.col("h_first_seen")),
        "last_included": F.when(has_new, d).otherwise(F.col("h_last_included")),
        "source_url": F.when(is_new, F.col("n_source_url")).otherwise(F.col("h_source_url")),
        "takeaways": F.when(has_new & ~is_new, F.when(F.size(F.coalesce(F.col("n_takeaways"), empty)) > 0, F.col("n_takeaways"))
                            .otherwise(F.coalesce(F.col("h_takeaways"), empty)))
                     .when(is_new, F.col("n_takeaways")).otherwise(F.col("h_takeaways")),
        "minhash": F.when(has_new & ~is_new, F.coalesce(F.col("n_minhash"), F.col("h_minhash")))
                    .when(is_new, F.col("n_minhash")).otherwise(F.col("h_minhash")),
    }
    for c in ["title", "author", "published_at", "summary", "content", "category", "tags", "relevance_score"]:
        out[c] = pick(c)
    return j.select(*[out[c].alias(c) for c in ARTICLE_COLUMNS])


def upsert_index(index: DataFrame, run: DataFrame) -> DataFrame:
    """Index upsert by run_date: new values win; overview kept from the old
    row when the new one is empty or null. Order is applied at read time."""
    cols = ["run_date", "generated_at", "source_urls", "count", "filename", "overview"]
    o = index.select(*[F.col(c).alias("o_" + c) for c in cols])
    n = run.select(*[F.col(c).alias("n_" + c) for c in cols])
    j = o.join(n, F.col("o_run_date") == F.col("n_run_date"), "full_outer")
    has_new = F.col("n_run_date").isNotNull()
    sel = [F.when(has_new, F.col("n_" + c)).otherwise(F.col("o_" + c)).alias(c) for c in cols[:-1]]
    ov = F.when(has_new, F.coalesce(F.when(F.col("n_overview") != "", F.col("n_overview")), F.col("o_overview"))) \
          .otherwise(F.col("o_overview"))
    return j.select(*sel, ov.alias("overview"))


def write_daily(selected: DataFrame, run_date: str, path: str) -> None:
    """Replace the run_date partition (dynamic partition overwrite). An empty
    selection still writes one marker row so the partition is cleared."""
    spark = selected.sparkSession
    rows = selected.withColumn("run_date", F.lit(run_date).cast("date")).withColumn("is_marker", F.lit(False))
    if rows.isEmpty():
        rows = spark.createDataFrame([], rows.schema).unionByName(
            rows.limit(0)).union(spark.range(1).select(
                *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields
                  if f.name not in ("run_date", "is_marker")],
                F.lit(run_date).cast("date").alias("run_date"), F.lit(True).alias("is_marker")))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date").parquet(path))


def write_daily_runs(selected: DataFrame, path: str) -> None:
    """Replace the partitions of all run dates that ``selected`` (with run_date) holds, in one job."""
    rows = selected.withColumn("run_date", F.col("run_date").cast("date")).withColumn("is_marker", F.lit(False))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_date").parquet(path)


HISTORY_SCHEMA = ("url string, title string, author string, published_at string, summary string, content string, category string, "
                  "relevance_score double, tags array<string>, takeaways array<string>, first_seen string, last_included string, "
                  "source_url string, minhash array<bigint>")
INDEX_SCHEMA = "run_date string, generated_at string, source_urls array<string>, count bigint, filename string, overview string"


def publish_run(spark, base: str, selected: DataFrame, run_date: str, generated_at: str, source_urls: list[str] | DataFrame, overview: str | None = None,
                mark: str | None = None) -> None:
    """Write one run: its daily rows, the history with them and the run's index row, under ``base``.

    The daily partition of the date is replaced. History and index become new
    versions of those read here, so of two runs at once one is refused. The
    index keeps one row a date, with the old overview if the run has none.
    ``source_urls``: a list, or a table with the column source_input.
    History is committed before the index. A run that dies in between may be
    repeated with the same rows, as every step gives the same again. Where the
    rows would be chosen anew, give a ``mark``: if the history holds it (see
    ``published``), only ``publish_index`` is left to do.
    """
    marked = {} if mark is None else {"mark": mark}
    history = f"{base}/history"
    before = current_version(spark, history)
    rows = cut_lineage(selected)
    write_daily(rows, run_date, f"{base}/daily")
    write_version(upsert_history(read_version(spark, history, HISTORY_SCHEMA, before), rows, run_date), history, before, **marked)
    publish_index(spark, base, rows, run_date, generated_at, source_urls, overview, mark)


def published(spark, base: str, table: str, mark: str) -> bool:
    """Whether ``history`` or ``index`` holds the run of this mark; marks ascend in the order of the runs."""
    return mark <= version_mark(spark, f"{base}/{table}")


def publish_index(spark, base: str, rows: DataFrame, run_date: str, generated_at: str, source_urls: list[str] | DataFrame, overview: str | None = None,
                  mark: str | None = None) -> None:
    """The second half of ``publish_run``: the index row of a run whose daily ``rows`` and history are written."""
    index = f"{base}/index"
    marked = {} if mark is None else {"mark": mark}
    runs = current_version(spark, index)
    if not isinstance(source_urls, DataFrame):
        source_urls = spark.createDataFrame([(u,) for u in source_urls], "source_input string")
    counted = rows.select(F.lit(1).alias("n"), F.lit(None).cast("string").alias("u")).unionByName(source_urls.select(F.lit(0).alias("n"), F.col("source_input").alias("u")))
    run = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.array_sort(F.collect_set("u")).alias("source_urls")).select(
        F.lit(run_date).alias("run_date"), F.lit(generated_at).alias("generated_at"), "source_urls", "count",
        F.lit(f"{run_date}.json").alias("filename"), F.lit(overview).cast("string").alias("overview"))
    write_version(upsert_index(read_version(spark, index, INDEX_SCHEMA, runs), run), index, runs, **marked)


def import_history(spark, path: str) -> DataFrame:
    """History from a JSON document {"articles": {url: article}}; a missing or malformed file gives an empty one."""
    article = ", ".join(c.replace(" ", ": ", 1) for c in HISTORY_SCHEMA.split(", "))
    whole = _json_document(spark, path, f"articles map<string, struct<{article}>>")
    rows = whole.select(F.explode("articles").alias("key", "a")).select("key", "a.*")
    return record_defaults(rows.withColumn("url", F.coalesce("url", "key")).drop("key"))


def import_index(spark, path: str) -> DataFrame:
    """Run index from a JSON document {"runs": [{date, ...}]}; a missing or malformed file gives an empty one."""
    fields = ", ".join(c.replace(" ", ": ", 1) for c in INDEX_SCHEMA.replace("run_date", "date").split(", "))
    whole = _json_document(spark, path, f"runs array<struct<{fields}>>")
    return whole.select(F.explode("runs").alias("r")).select("r.*").withColumnRenamed("date", "run_date")


def _json_document(spark, path: str, schema: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(path)


def read_daily(spark, path: str, run_date: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if run_date is not None:
        df = df.where(F.col("run_date") == F.lit(run_date).cast("date"))
    return df.where(~F.col("is_marker")).drop("is_marker")


def emit_json(selected: DataFrame) -> DataFrame:
    """Dry-run emission: each selected row as JSON text (nulls kept)."""
    cols = [c for c in ARTICLE_COLUMNS if c in selected.columns]
    return selected.select("url", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def public_view(df: DataFrame) -> DataFrame:
    return df.drop(*PUBLIC_DROP)


def publish_export(daily: DataFrame, index: DataFrame, path: str) -> DataFrame:
    """Write the public daily rows (a folder per run_date) and the index as JSON lines, then report on them."""
    out = public_view(daily)
    out.write.mode("overwrite").partitionBy("run_date").json(f"{path}/daily")
    index.write.mode("overwrite").json(f"{path}/index")
    return publish_report(out, index)


def publish_report(daily: DataFrame, index: DataFrame) -> DataFrame:
    """Counts per exported artefact and total size in KB of their JSON."""
    d = daily.select(F.to_json(F.struct(*daily.columns)).alias("j"))
    i = index.select(F.to_json(F.struct(*index.columns)).alias("j"))
    return (d.select(F.lit("daily").alias("artefact"), "j").unionByName(i.select(F.lit("index").alias("artefact"), "j"))
            .groupBy("artefact").agg(F.count(F.lit(1)).alias("rows"),
                                     F.round(F.sum(F.octet_length("j")) / 1024.0, 3).alias("kb")))
