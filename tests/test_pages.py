import random

from pyspark.sql import functions as F

from sieveworks.operators import pages as PG
from sieveworks.plans.curate import page_lookup


def table(spark, path):
    rng = random.Random(1)
    rows = [(f"https://h{i % 7}.example/{i}", i, f"<p>page {i} {rng.random()}</p>") for i in range(300)]
    rows += [("https://hot.example/", 1000 + i, f"<p>snapshot {i}</p>") for i in range(150)]  # a third of all rows is one URL
    rows += [("https://h1.example/1", -5, ""), ("https://h2.example/2", -5, None), (None, 1, "x"), ("https://h3.example/3", 3, "<p>as early</p>"), ("https://late.example/", None, "x")]
    df = spark.createDataFrame(rows, "url string, page_id long, html string").repartition(3)
    return df, rows, PG.publish_pages(df, path, parts=8, row_group_bytes=4096)


def want(rows, urls):
    first = {}
    for u, i, h in rows:
        if u is not None and u in urls and h and i is not None and (u not in first or (i, h) < first[u]):
            first[u] = (i, h)
    return {u: h for u, (_, h) in first.items()}


def test_lookup_equals_a_scan_on_both_paths(spark, tmp_path, monkeypatch):
    _, rows, pages = table(spark, str(tmp_path / "pages"))
    urls = [f"https://h{i % 7}.example/{i}" for i in range(0, 300, 3)] + ["https://hot.example/", "https://none.example/", None, "https://h1.example/1", "https://h2.example/2"]
    wanted = spark.createDataFrame([(u,) for u in urls + urls[:5]], "_page_url string")
    few = {r._page_url: r.html for r in pages.lookup(wanted).collect()}
    monkeypatch.setattr(PG, "LITERAL_KEYS", 3)
    many = pages.lookup(wanted).collect()
    assert few == {r._page_url: r.html for r in many} == want(rows, set(urls)) and len(many) == len(few)
    joined = page_lookup(wanted.withColumn("url", F.col("_page_url")), pages)
    assert joined.count() == sum(u in few for u in urls + urls[:5])


def test_the_scan_is_pruned_by_the_wanted_pages(spark, tmp_path):
    _, rows, pages = table(spark, str(tmp_path / "pages"))
    wanted = spark.createDataFrame([("https://h5.example/5",)], "_page_url string")
    out = pages.lookup(wanted)
    plan = out._jdf.queryExecution().executedPlan().toString()
    scan = next(t for t in plan.splitlines() if "FileScan parquet" in t and "html" in t)
    assert "part" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(url" in scan or "In(url" in scan or "url IN" in scan
    assert {r.html for r in out.collect()} == set(want(rows, {"https://h5.example/5"}).values())


def test_no_wanted_page_and_an_empty_table(spark, tmp_path):
    df, _, pages = table(spark, str(tmp_path / "pages"))
    none = spark.createDataFrame([], "_page_url string")
    assert pages.lookup(none).count() == 0
    empty = PG.publish_pages(df.limit(0), str(tmp_path / "empty"), parts=8)
    assert empty.lookup(spark.createDataFrame([("https://h1.example/1",)], "_page_url string")).count() == 0
