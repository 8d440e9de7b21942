import random

import pytest

from sieveworks.llm.components import connected_components
from sieveworks.llm.near_dup import near_duplicates

from .brute import components


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


def test_random_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    texts, n = {}, 0
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 120))]
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(400)}"
            texts[n] = rng.choice([" ", "\n", "\t "]).join(t).upper() if n % 3 else " ".join(t)
            n += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert result(df) == components(texts)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
            (7, "é " * 300), (8, "x" * 3_000_000), (9, "x" * 3_000_000), (None, "one two"), (10, "a b c d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp_a", "'z' as bands", "2 as rep")
    got = {r.doc_id: r for r in near_duplicates(df).collect()}
    assert len(got) == 11
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 7, 10)] == [0, 0, 0, 1, 1, 1]
    assert [got[i].component_id for i in range(1, 11)] == [1, 2, 3, 4, 4, 6, 7, 8, 8, 10]
    assert [got[i].kept for i in (4, 5, 8, 9)] == [True, False, True, False]
    assert got[None].kept and got[None].component_id is None


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s"), (3, "t u v w")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("edges", [[], [(i, i + 1) for i in range(60)], [(9, 1), (1, 9), (5, 5), (3, None)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {} if not edges else {i: 0 for i in range(61)} if len(edges) > 5 else {1: 1, 9: 1}
    assert got == want


def test_a_hot_bucket_with_one_stray_and_one_of_many_components(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sieveworks.llm import near_dup as module

    n = 3000
    # Bucket 1: one component of n sets and a stray like the first of them; bucket 2: sets of ten components, every third alike.
    base = lambda c: [c * 1000 + k for k in range(40)]
    hot = {i: (1, 0, [*base(0)[:36], *(100_000 + 4 * i + k for k in range(4))]) for i in range(n)} | {n: (1, n, base(0))}
    mixed = {n + 1 + i: (2, n + 1 + i % 10, base(1 + i % 3)) for i in range(60)}
    rows = [(d, *x) for d, x in (hot | mixed).items()]
    sets = {d: frozenset(s) for d, _, _, s in rows}
    schema = "doc_id long, shingles array<long>, parity array<long>"
    cell = lambda s: [i for i in range(module.PARITY_BITS) if sum(x % module.PARITY_BITS == i for x in s) % 2]
    import numpy as np
    flat = {d: module.parity(np.array([x % module.PARITY_BITS for x in s]), 1, module.PARITY_BITS).ravel().tolist() for d, s in sets.items()}
    assert len(cell(base(0))) == 40
    table = spark.createDataFrame([(d, sorted(s), flat[d]) for d, s in sets.items()], schema)
    bucket = spark.createDataFrame([(d, b, c) for d, b, c, _ in rows], "doc_id long, band long, component long")
    like = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = {(min(a, n), max(a, n)) for a in hot if a != n and like(a, n)}
    want |= {(min(a, b), max(a, b)) for a in mixed for b in mixed if a < b and mixed[a][1] != mixed[b][1] and like(a, b)}
    for block in (2000, 100):
        monkeypatch.setattr(module, "BLOCK_ROWS", block)
        got = module._cross_pairs(bucket, table, 75).withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
        pairs = [(r.lo, r.hi) for r in got.collect()]
        assert len(pairs) == len(set(pairs)) and want <= set(pairs) and len(want) > 3000
        assert not any({a, b} <= set(range(n)) for a, b in pairs)
