import heapq
import random
import zlib
from collections import defaultdict

from sieveworks.llm import sharding as module
from sieveworks.llm.sharding import schedule, shard


def plain(docs, shards):
    """Shard of each text, group by group in order of size."""
    groups = defaultdict(list)
    for d, t in docs:
        groups[t or ""].append(d)
    order = sorted(groups, key=lambda t: (-len(groups[t]) * (len(t.encode()) + 8), min((d for d in groups[t] if d is not None), default=-1)))
    load, out = [0] * shards, {}
    for t in order:
        s = load.index(min(load))
        out[t] = s
        load[s] += len(groups[t]) * (len(t.encode()) + 8)
    return out


def check(spark, docs, shards):
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size", "3 as part", "4 as hash").repartition(3)
    got = shard(df, shards).collect()
    assert len(got) == len(docs)
    text = {(len((t or "").encode()) + 8, zlib.crc32((t or "").encode())): t or "" for _, t in docs}
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else -1))
        where[text[r["size"], r.text_crc32]].add(r.shard)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == \
        sorted((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in docs if d is not None)
    for s in slots.values():
        s.sort()
        assert [x[0] for x in s] == list(range(len(s))) and [x[1] for x in s] == sorted(x[1] for x in s)
    assert all(len(s) == 1 for s in where.values()) and all(0 <= s < shards for s in slots)
    return {t: s.pop() for t, s in where.items()}, got


def test_few_groups_are_scheduled_one_by_one(spark):
    rng = random.Random(5)
    docs = [(i, None if i % 50 == 0 else "" if i % 50 == 1 else rng.choice("aé") * rng.randrange(300)) for i in range(400)]
    docs += [(1000 + i, "copy " * 20) for i in range(200)] + [(7, docs[7][1]), (None, "no id"), (None, "no id")]
    got, _ = check(spark, docs, 5)
    assert got == plain(docs, 5)


def test_many_small_groups_are_bundled_and_level(spark, monkeypatch):
    monkeypatch.setattr(module, "FINE", 2)
    monkeypatch.setattr(module, "HEAVY", 3)
    rng = random.Random(6)
    docs = [(i, f"{i} " + "x" * rng.randrange(400)) for i in range(3000)] + [(5000 + i, "a third of all rows") for i in range(1500)]
    _, got = check(spark, docs, 4)
    load = defaultdict(int)
    for r in got:
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.002 * sum(load.values()) / 4


def test_edges(spark):
    check(spark, [(1, None)], 24)
    check(spark, [(None, None), (None, None), (3, "")], 2)
    assert shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    check(spark, [(1, "one very long text " * 100_000), (2, "b"), (3, "c")], 2)


def test_heap_equals_scanning_the_loads():
    rng = random.Random(1)
    items = [(rng.randrange(1, 40), i) for i in range(300)]
    load, want = [0] * 7, {}
    for size, i in sorted(items, key=lambda x: (-x[0], x[1])):
        s = load.index(min(load))
        want[i], load[s] = s, load[s] + size
    assert schedule(items, 7) == [want[i] for i in range(300)]
    assert heapq.nsmallest(1, load)[0] >= sum(x[0] for x in items) / 7 - 40
