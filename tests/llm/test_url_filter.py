import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sieveworks.llm.url_filter import BLOCK, RULES, filter_urls, match, mine

CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("http://EXAMPLE.ORG/es/1?q#f", "example.org", "/es/1", "example.org/es/", "block"),
    ("x://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://b.com/fr/?/de/", "b.com", "/fr/", "com/fr/", "allow"),
    ("https://b.com/de/://c.net/", "b.com", "/de/://c.net/", "com/de/", "block"),
    ("http://org", "org", "", None, "allow"),
    ("http://b.com?x=/de/", "b.com", "", None, "allow"),
    ("mailto:a@b.org", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://É.Org/a\nb", "É.org", "/a\nb", "org/", "allow"),
    ("http://" + "x" * 100_000 + ".com/de/", "x" * 100_000 + ".com", "/de/", "com/de/", "block"),
]


def test_fixed_rules(spark):
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)] + [(None, "http://a.org/x"), (0, CASES[0][0])],
                                  "page_id long, url string").selectExpr("*", "'z' as host", "1 as tokens")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_urls(pages, labels).collect()
    assert len(got) == len(CASES) + 2
    for r in got:
        if r.page_id is not None:
            assert (r.host, r.path, r.rule, r.verdict) == CASES[r.page_id][1:]
    assert filter_urls(pages.limit(0), labels).collect() == []


@pytest.fixture(scope="module")
def baskets():
    rng = random.Random(8)
    return [(sorted(rng.sample("abcdefg", rng.randrange(1, 6))), rng.random() < 0.3) for _ in range(300)] + [(["a", "z"], True)] * 40


def test_mined_rules_match_brute_force(spark, baskets):
    known = spark.createDataFrame(baskets, "tokens array<string>, blocked boolean")
    rules = mine(known, 0.05, 0.45)
    count, bad = Counter(), Counter()
    for t, b in baskets:
        for k in range(1, len(t) + 1):
            for x in combinations(t, k):
                count[x] += 1
                bad[x] += b
    least = 0.05 * len(baskets)
    want = {x: bad[x] / n for x, n in count.items() if bad[x] >= least and bad[x] / n >= 0.45}
    assert {tuple(r["items"]): r.confidence for r in rules.collect()} == want and want
    assert BLOCK not in {r.anchor for r in rules.collect()}
    sets = spark.createDataFrame([(list(t),) for t in {tuple(t) for t, _ in baskets}], "tokens array<string>")
    got = {tuple(r.tokens): r.confidence for r in match(sets, rules).collect()}
    assert got == {t: max(want[x] for x in want if set(x) <= set(t)) for t in {tuple(t) for t, _ in baskets} if any(set(x) <= set(t) for x in want)}


def test_labels_teach_unruled_hosts(spark):
    rows = [(i, f"http://{'spam-shop' if i % 3 == 0 else f'good{i % 7}'}.example.net/en/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300, 2)] + [(None, 0, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    got = filter_urls(pages, labels)
    assert {(r.page_id % 3 == 0) == (r.verdict == "block") for r in got.collect()} == {True}
    assert got.where(F.col("rule").isNotNull()).count() == 0 and len(RULES) == 5


def test_fixed_rules_teach_nothing(spark):
    """Pages that com/de/ blocks share their tokens with open pages, of which the labelled ones are clean."""
    urls = [f"http://blog.example.com/de/{i}" for i in range(200)] + [f"http://blog.example.net/de/{i}" for i in range(20)] \
        + [f"http://bad.example.net/{i}" for i in range(6)] + [f"http://few.example.net/{i}" for i in range(4)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 205), 0) for i in [*range(50), *range(200, 205), *range(220, 230)]], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.mined is not None) for r in filter_urls(pages, labels).collect()}
    assert [got[i] for i in range(200)] == [("block", False)] * 200
    assert [got[i] for i in range(200, 220)] == [("allow", False)] * 20
    assert [got[i] for i in range(220, 226)] == [("block", True)] * 6
    assert [got[i] for i in range(226, 230)] == [("allow", False)] * 4  # four pages are too few for a rule
