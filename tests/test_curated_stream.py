import datetime
import json
import random

import pytest

from sieveworks.functions import html as H
from sieveworks.functions import minhash as M
from sieveworks.functions.text import normalize_title
from sieveworks.operators import store as ST
from sieveworks.operators.annotate import annotate_with
from sieveworks.plans.catalog import word_scorer
from sieveworks.plans.curate import CurateParams
from sieveworks.streaming.curated import LANDING_SCHEMA, curate_stream

DATES = ["2024-01-01", "2024-02-10", "2024-03-21"]  # 40 days apart: the window of 60 sees the run before, not the one before that
PARAMS = CurateParams("", max_articles=4, max_per_domain=1, preferred_domains=["b.example"])


def scorer(df):
    def make():
        def answer(request):
            if "boom" in request:
                raise RuntimeError("refused")
            return json.dumps({"summary": "s", "takeaways": [], "category": "news", "relevance_score": request.count(" plus") / 16, "tags": []})
        return answer
    return annotate_with(df, make)


def fixture(spark, tmp_path):
    rng = random.Random(3)
    base = [[f"w{i}x{k}" for k in range(80)] for i in range(9)]
    pages = []
    for i in range(30):
        words = list(base[i % 9]) + ["plus"] * rng.randrange(1, 9) + (["boom"] if i % 7 == 2 else [])
        words[rng.randrange(80)] = f"n{i}"
        title = f"<title>Title {i % 20}</title>" if i % 3 else ""
        pages.append((i, f"https://{'abc'[i % 3]}.example/p{i:02d}", f"{title}<article>{' '.join(words)}</article>"))
    urls = [u for _, u, _ in pages] + ["https://a.example/gone"]
    hits = {d: rng.sample(urls, 18) for d in DATES}
    rows = [(d, "tavily", t, f"term{t}", json.dumps({"results": [{"url": u} for u in hits[d][t::2]]})) for d in DATES for t in range(2)]
    landing = str(tmp_path / "landing")
    spark.createDataFrame(rows, LANDING_SCHEMA).coalesce(1).write.parquet(landing)
    links = [("https://a.example/index", urls[0]), ("https://a.example/index", urls[4])]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    return landing, table, spark.createDataFrame(links, "source_url string, url string"), {d: set(hits[d]) | {u for _, u in links} for d in DATES}


def fold(records, hits):
    """One run after the other, one candidate after the other."""
    history, daily, index = {}, [], []
    for date in DATES:
        cutoff = str(datetime.date.fromisoformat(date) - datetime.timedelta(days=60))
        seen = [(u, h) for u, h in history.items() if h["last"] >= cutoff]
        kept = []
        for url in sorted(hits[date]):
            r = records.get(url)
            if r is None or any(url == u for u, _ in seen):
                continue
            others = [h["rec"] for _, h in seen] + kept
            if not any((r.key and r.key == o.key) or sum(x == y for x, y in zip(r.sig, o.sig, strict=True)) >= 64 for o in others):
                kept.append(r)
        scored = [(r.content.count(" plus") / 16, r.url) for r in kept if "boom" not in r.content]
        order = sorted(((-s * (1.3 if "//b." in u else 1), u, s) for s, u in scored if s > 0))
        first, more, hosts = [], [], set()
        for _, u, s in order:
            (more if u.split("/")[2] in hosts else first).append((u, s))
            hosts.add(u.split("/")[2])
        chosen = (first + more)[:4]
        for u, _ in chosen:
            history[u] = {"first": history.get(u, {"first": date})["first"], "last": date, "rec": records[u]}
        daily += [(date, k + 1, u, round(s, 6)) for k, (u, s) in enumerate(chosen)]
        index.append((date, len(chosen), f"{len(chosen)} items"))
    return sorted(daily), sorted((u, h["first"], h["last"]) for u, h in history.items()), index


def results(spark, base):
    daily = sorted((str(r.run_date), r["rank"], r.url, round(r.relevance_score, 6)) for r in ST.read_daily(spark, f"{base}/daily").collect())
    history = sorted((r.url, r.first_seen, r.last_included) for r in ST.read_version(spark, f"{base}/history", ST.HISTORY_SCHEMA).collect())
    index = sorted((r.run_date, r["count"], r.overview) for r in ST.read_version(spark, f"{base}/index", ST.INDEX_SCHEMA).collect())
    return daily, history, index


def test_runs_equal_the_fold_after_two_deaths(spark, tmp_path, monkeypatch):
    """Three runs in one batch: dead before the second run's history, replayed, dead before the third's index row, replayed."""
    landing, pages, links, hits = fixture(spark, tmp_path)
    records = H.extract_records(pages)
    records = {r.url: r for r in records.select("url", "content", normalize_title("title").alias("key"), M.signature("content").alias("sig")).collect()}
    want = fold(records, hits)
    assert all(n for _, n, _ in want[2]) and len(want[1]) < len(want[0])  # an article comes back after the window
    base, real, left = str(tmp_path / "out"), ST.write_version, {"history": 1, "index": 2}

    def summarise():
        return lambda body: f"{body.count('- ')} items"

    def dying(df, path, *args, **kwargs):
        name = path.rsplit("/", 1)[1]
        left[name] -= 1
        if left[name] == -1:
            raise OSError(f"gone before {name}")
        return real(df, path, *args, **kwargs)

    monkeypatch.setattr(ST, "write_version", dying)
    for name in ("history", "index"):
        with pytest.raises(Exception, match=f"gone before {name}"):
            curate_stream(spark, landing, base, pages, links, scorer, PARAMS, summarise)
    curate_stream(spark, landing, base, pages, links, scorer, PARAMS, summarise)
    assert results(spark, base) == want
    assert left == {"history": -3, "index": -2}  # of each run one history and one index was committed


def test_runs_of_a_batch_read_and_sign_their_pages_once(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"https://a.example/p{i}", f"<article>{' '.join(f'w{i}x{k}' for k in range(40))} plus</article>") for i in range(3)],
                                  "page_id long, url string, html string")
    rows = [(d, "tavily", 0, "t", json.dumps({"results": [{"url": f"https://a.example/p{i}"} for i in few]})) for d, few in zip(DATES[:2], ([0, 1], [1, 2]), strict=True)]
    spark.createDataFrame(rows, LANDING_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "landing"))
    links = spark.createDataFrame([], "source_url string, url string")
    calls, real = [], H.extract_records
    monkeypatch.setattr(H, "extract_records", lambda *a, **k: calls.append(1) or real(*a, **k))
    curate_stream(spark, str(tmp_path / "landing"), str(tmp_path / "out"), pages, links, word_scorer, PARAMS)
    daily = [(str(r.run_date), r.url[-2:]) for r in ST.read_daily(spark, str(tmp_path / "out/daily")).collect()]
    assert sorted(daily) == [(DATES[0], "p0"), (DATES[0], "p1"), (DATES[1], "p2")]
    assert len(calls) == 1  # and not one a run
