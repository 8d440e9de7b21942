import random
from collections import Counter

import pytest

from sieveworks.operators.rank import select_top

SCHEMA = "url string, host string, eff_score double, published_at string"


def top(spark, rows, n, cap):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "eff_score AS relevance_score", "CAST(NULL AS STRING) AS first_seen")
    return select_top(df, n, cap).orderBy("rank").collect()


def test_order_by_score_then_date_then_url(spark):
    rows = [("u4", "a", 0.5, None), ("u3", "b", 0.5, "2024-01-01"), ("u2", "c", 0.5, ""), ("u1", "d", 0.9, None), ("u0", "e", 0.0, "2025-01-01")]
    assert [r.url for r in top(spark, rows, 9, None)] == ["u1", "u3", "u2", "u4"]


def test_a_full_host_only_tops_up(spark):
    rows = [(f"a{i}", "a", 0.9 - i / 100, None) for i in range(5)] + [("b0", "b", 0.1, None)]
    assert [(r.url, r.overflow) for r in top(spark, rows, 4, 2)] == [("a0", False), ("a1", False), ("b0", False), ("a2", True)]
    assert [r.url for r in top(spark, rows, 3, 2)] == ["a0", "a1", "b0"]


@pytest.mark.parametrize("n,cap", [(4, 2), (10, 1), (40, 3)])
def test_selection_properties(spark, n, cap):
    rng = random.Random(n)
    rows = [(f"u{i:02d}", rng.choice("abc"), rng.choice([0.0, 0.25, 0.5, 1.0]), rng.choice([None, "2024-01-02", "2024-03-04"])) for i in range(40)]
    got = top(spark, rows, n, cap)
    positive = [r for r in rows if r[2] > 0]
    room = sum(min(cap, c) for c in Counter(r[1] for r in positive).values())
    assert len(got) == min(n, len(positive)) and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    capped = [r for r in got if not r.overflow]
    assert max(Counter(r.host for r in capped).values()) <= cap and len(capped) == min(n, room)
    key = lambda r: (-r.eff_score, [-ord(c) for c in r.published_at or ""] or [1], r.url)
    for part in (capped, [r for r in got if r.overflow]):
        assert [r.eff_score for r in part] == sorted((r.eff_score for r in part), reverse=True)
    least = {h: min((key(r) for r in capped if r.host == h), default=None) for h in "abc"}
    assert all(key(r) >= least[r.host] for r in got if r.overflow)


def test_n_zero_selects_nothing(spark):
    assert top(spark, [("u", "h", 1.0, None)], 0, 2) == []
