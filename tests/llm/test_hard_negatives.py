import math
import random

import numpy as np
import pytest

from sieveworks.llm.hard_negatives import LIMIT, components, hard_negatives, packed_scores, relabelled

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, every=100, keep=5):
    ok = [(i, [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in v], y) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    fit = lambda x: max(-LIMIT - 1, min(LIMIT, x))
    out = []
    for k, (a, va, ya) in enumerate(ok):
        if a % every:
            continue
        scored = [(-dot(va, v), i, y) for j, (i, v, y) in enumerate(ok) if j != k and len(v) == len(va)]
        for ps, p, _ in sorted((s, i, y) for s, i, y in scored if y == ya)[:keep]:
            hard = sorted((s, i) for s, i, y in scored if y != ya and 80 * -ps <= 100 * -s <= 100 * -ps)[:keep]
            out += [(a, p, r + 1, i, fit(-ps), fit(-s)) for r, (s, i) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as row", "2 as block", "3 as d").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives(df, **how).collect())
    assert got == plain(rows)
    return got


def vectors(rng, n, dims=8, scale=1.0):
    return [(i, [rng.gauss(0.3, 1) * scale for _ in range(dims)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("scale", [0.01, 1.0, 1e6, 1e12, 1e40])
def test_packed_scores_are_exact_at_any_width(scale):
    rng = np.random.default_rng(2)
    for low in (-1.0, 0.2, -3.0):
        a, c = components(rng.uniform(low, 1.0, (7, 33)) * scale), components(rng.uniform(-1.0, 2.0, (50, 33)) * scale)
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in c] for p in a]
        assert packed_scores(a, c).tolist() == want
    assert packed_scores(a[:0], c).shape == (0, 50) and packed_scores(a[:, :0], c[:, :0]).tolist() == [[0] * 50] * 7


def test_equals_brute_force_in_one_block_and_in_many(spark):
    rows = vectors(random.Random(0), 700)
    assert len(check(spark, rows)) > 100
    assert check(spark, rows, block_rows=100, block_anchors=2)


def test_ties_a_hot_vector_and_a_hot_label(spark):
    rng = random.Random(1)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot if i % 3 == 0 else [rng.choice([0.5, 1.0, -0.25]) for _ in range(3)], 1 if i % 4 else rng.randrange(3)) for i in range(600)]
    assert check(spark, rows, block_rows=64)


def test_odd_rows(spark):
    rng = random.Random(2)
    odd = [(None, [1.0, 2.0], 0), (100, None, 0), (200, [1.0, None], 0), (300, [1.0, float("nan")], 1), (400, [float("inf"), 1.0], 1), (500, [1.0, 1.0], None),
           (600, [], 0), (601, [], 1), (602, [], 0), (700, [1.0, 2.0, 3.0], 1), (701, [1.0, 2.0, 3.0], 1), (702, [1.0, 2.0, 2.9], 0), (0, [0.0, 0.0], 0)]
    some = [(1000 + i, [rng.random(), rng.random()], rng.randrange(2)) for i in range(150)]
    check(spark, odd + some)
    check(spark, some + [(1000, *some[0][1:]), (1003, *some[3][1:])])  # repeated rows, an anchor among them
    check(spark, [(i, [x * 1e20 for x in v], y) for i, v, y in some])  # scores beyond 64 bits
    assert hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    assert hard_negatives(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).collect() == []


def test_every_seventh_label_moves_on(spark):
    df = spark.createDataFrame([(7, None, 9), (8, None, 9), (14, None, None)], SCHEMA)
    assert [r.label for r in relabelled(df).orderBy("vec_id").collect()] == [0, 9, None]
