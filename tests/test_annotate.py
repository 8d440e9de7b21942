import json

import pytest

from sieveworks.operators.annotate import annotate_with
from sieveworks.operators.candidates import candidates
from sieveworks.operators.store import HISTORY_SCHEMA
from sieveworks.operators.views import overview_with
from sieveworks.plans.curate import CurateParams, curate

RECORD = "id int, title string, source_url string, author string, published_at string, content string"


@pytest.fixture
def picky():  # a closure, as workers cannot import this module
    def make():
        def answer(request):
            if "boom" in request:
                raise RuntimeError("refused")
            if "silent" in request:
                return None
            if "number" in request:
                return 7
            if "broken" in request:
                return "{"
            return json.dumps({"summary": "S", "takeaways": None, "category": "news", "relevance_score": 0.5, "tags": ["t"]})
        return answer
    return make


def test_a_failing_row_does_not_stop_the_others(spark, picky):
    rows = [(i, None, None, None, None, c) for i, c in enumerate(["fine", "boom", "silent", "number", "broken", None, ""])]
    got = {r.id: r for r in annotate_with(spark.createDataFrame(rows, RECORD), picky).collect()}
    assert [got[i].annotation_error for i in range(7)] == [None, "RuntimeError: refused", "no answer", "TypeError: the answer is int, not text", None, None, None]
    assert (got[0].summary, got[0].takeaways, got[0].category, got[0].relevance_score, got[0].tags) == ("S", [], "news", 0.5, ["t"])
    assert got[1].summary is None and got[1].relevance_score is None and got[1].tags is None
    assert (got[4].category, got[4].relevance_score) == ("other", 0.0)  # an answer that is no JSON is no failure
    assert annotate_with(spark.createDataFrame([], RECORD), picky).collect() == []


def test_each_row_is_asked_once(spark, tmp_path, picky):
    calls = str(tmp_path / "calls")

    def counting():
        def answer(request):
            with open(calls, "a") as f:
                f.write("x\n")
            return picky()(request)
        return answer
    rows = [(i, None, None, None, None, "fine" if i % 3 else "boom") for i in range(30)]
    out = annotate_with(spark.createDataFrame(rows, RECORD), counting)
    assert out.where("annotation_error is null and relevance_score > 0 and category = 'news'").count() == 20
    assert len((tmp_path / "calls").read_text().split()) == 30


def test_a_failed_annotation_still_blocks_its_duplicates(spark, picky):
    body = " ".join(f"word{i}" for i in range(300))
    urls = ["https://a.example/x", "https://b.example/x", "https://c.example/x"]
    texts = [body + " boom", body + " fine", " ".join(f"other{i}" for i in range(300))]
    pages = spark.createDataFrame([(i, u, f"<title>T {i}</title><article>{t}</article>") for i, (u, t) in enumerate(zip(urls, texts, strict=True))],
                                  "page_id long, url string, html string")
    hits = spark.createDataFrame([("t", 0, i, u) for i, u in enumerate(urls)], "term string, term_pos int, result_pos int, url string")
    none = spark.createDataFrame([], "source_url string, url string")
    selected, audit, run = curate(candidates(none, hits), pages, spark.createDataFrame([], HISTORY_SCHEMA), lambda df: annotate_with(df, picky), CurateParams("2024-06-01"))
    assert [(r.url, r.category) for r in selected.collect()] == [(urls[2], "news")]
    assert {r.url: (r.reason, r.blocked_by) for r in audit.collect()} == {
        urls[0]: ("annotation_failed", None), urls[1]: ("near_dup", urls[0]), urls[2]: ("kept", None)}
    assert [(r["count"], r.thin_run) for r in run.collect()] == [(1, True)]


def test_a_run_goes_on_without_an_overview(spark):
    daily = spark.createDataFrame([("2024-01-01", 1, "A", " s "), ("2024-01-02", 1, "boom", None), ("2024-01-03", 1, " ", "x")],
                                  "run_date string, rank int, title string, summary string")

    def make():
        def answer(body):
            if "boom" in body:
                raise TimeoutError("late")
            return "" if "x" in body else f" {body} "
        return answer
    got = {r.run_date: (r.overview, r.overview_error) for r in overview_with(daily, make).collect()}
    assert got == {"2024-01-01": ("- A\n  s", None), "2024-01-02": (None, "TimeoutError: late"), "2024-01-03": (None, None)}
