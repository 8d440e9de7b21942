import pytest
from pyspark.sql import functions as F

from sieveworks.operators.candidates import candidates, check_inputs, harvested, search_hits
from sieveworks.operators.store import HISTORY_SCHEMA, import_history, read_version, write_version
from sieveworks.plans.catalog import word_scorer
from sieveworks.plans.curate import CurateParams, curate

BODY = " ".join(f"word{i}" for i in range(300))


def pages(spark, urls):
    rows = [(i, u, f"<html><head><title>T {i}</title></head><article>{BODY} {i}</article></html>") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_strict_mode_narrows_before_dedup(spark):
    urls = ["https://aaa.example/x", "https://listed.example/x"]  # near copies; the unlisted one comes first
    hits = spark.createDataFrame([("t", 0, i, u) for i, u in enumerate(urls)], "term string, term_pos int, result_pos int, url string")
    none = spark.createDataFrame([], "source_url string, url string")
    params = CurateParams("2024-06-01", domain_mode="strict", preferred_domains=["listed.example"])
    selected, audit, _ = curate(candidates(none, hits), pages(spark, urls), spark.createDataFrame([], HISTORY_SCHEMA), word_scorer, params)
    assert [r.url for r in selected.collect()] == ["https://listed.example/x"]
    assert [(r.url, r.reason) for r in audit.collect()] == [("https://listed.example/x", "kept")]


def test_first_writer_and_fallback(spark):
    sources = spark.createDataFrame([("s2",), ("s1",), ("s3",)], "source_url string")
    links = spark.createDataFrame([("s2", "a"), ("s1", "a"), ("s1", "b"), ("s1", None)], "source_url string, url string")
    hits = spark.createDataFrame([("t10", 10, 0, "c"), ("t2", 2, 1, "c"), ("t2", 2, 0, "b"), ("t", 0, 0, "https://x.medium.com/a")],
                                 "term string, term_pos int, result_pos int, url string")
    got = candidates(harvested(sources, links), search_hits(hits))
    assert {r.url: r.provenance for r in got.collect()} == {"a": "s1", "b": "s1", "s3": "s3", "c": "t2"}
    with pytest.raises(ValueError):
        check_inputs(sources.limit(0), hits.limit(0))


def test_missing_and_malformed_history(spark, tmp_path):
    path = tmp_path / "history.json"
    assert import_history(spark, str(path)).collect() == []
    path.write_text('{"articles": [')
    assert import_history(spark, str(path)).collect() == []
    path.write_text('{"articles": {"u1": {"url": "u1", "title": "T"}}}')
    assert [(r.url, r.title, r.takeaways) for r in import_history(spark, str(path)).collect()] == [("u1", "T", [])]


def test_versioned_table(spark, tmp_path):
    base = str(tmp_path / "history")
    assert read_version(spark, base, HISTORY_SCHEMA).collect() == []
    for title in ("one", "two"):
        df = spark.createDataFrame([], HISTORY_SCHEMA).union(read_version(spark, base, HISTORY_SCHEMA))
        write_version(df.limit(0).unionByName(spark.range(1).select(*[
            (F.lit(title) if f.name == "title" else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])), base)
    assert [r.title for r in read_version(spark, base, HISTORY_SCHEMA).collect()] == ["two"]
