import pytest
from pyspark.sql import functions as F

from sieveworks.operators import store as ST
from sieveworks.operators import versions as V


def rows(spark, path, number=None):
    return sorted(r.x for r in V.read_version(spark, path, "x long", number).collect())


def test_numbers_readers_and_removal(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.current_version(spark, path) == 0 and rows(spark, path) == []
    for k in range(1, 6):
        assert V.write_version(spark.range(k).toDF("x"), path, keep=2) == k
        assert rows(spark, path) == list(range(k))
    assert rows(spark, path, 4) == [0, 1, 2, 3]
    assert sorted(p.name for p in (tmp_path / "t" / "_commits").iterdir() if not p.name.startswith(".")) == ["4", "5"]
    assert len(list((tmp_path / "t").glob("data-*"))) == 2


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    V.write_version(spark.range(3).toDF("x"), path)
    read = V.current_version(spark, path)
    V.write_version(spark.range(4).toDF("x"), path, read)
    with pytest.raises(V.VersionConflict):
        V.write_version(spark.range(9).toDF("x"), path, read)
    assert rows(spark, path) == [0, 1, 2, 3] and len(list((tmp_path / "t").glob("data-*"))) == 2


def test_a_crash_between_write_and_commit_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.write_version(spark.range(3).toDF("x"), path)
    real = V.commit_version

    def dies(*_):
        raise OSError("gone")

    monkeypatch.setattr(V, "commit_version", dies)
    with pytest.raises(OSError):
        V.write_version(spark.range(9).toDF("x"), path)
    assert rows(spark, path) == [0, 1, 2]
    monkeypatch.setattr(V, "commit_version", real)
    assert V.write_version(V.read_version(spark, path, "x long").union(spark.range(7, 8)), path) == 2
    assert rows(spark, path) == [0, 1, 2, 7]


def test_a_run_repeated_after_dying_between_history_and_index(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "runs")
    one = ST.record_defaults(spark.createDataFrame([("u1", "T", "s")], "url string, title string, source_url string"))
    real, calls = ST.write_version, []

    def second_dies(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("gone")
        return real(*a)

    monkeypatch.setattr(ST, "write_version", second_dies)
    with pytest.raises(OSError):
        ST.publish_run(spark, base, one, "2024-01-01", "t0", ["s"], "first")
    monkeypatch.setattr(ST, "write_version", real)
    ST.publish_run(spark, base, one, "2024-01-01", "t1", ["s"], "first")
    ST.publish_run(spark, base, one.withColumn("url", F.lit("u2")), "2024-01-01", "t2", ["s"])
    assert [(r.url, r.first_seen) for r in V.read_version(spark, f"{base}/history", ST.HISTORY_SCHEMA).orderBy("url").collect()] == [
        ("u1", "2024-01-01"), ("u2", "2024-01-01")]
    index = V.read_version(spark, f"{base}/index", ST.INDEX_SCHEMA).collect()
    assert [(r.run_date, r.generated_at, r["count"], r.overview) for r in index] == [("2024-01-01", "t2", 1, "first")]
    assert [r.url for r in ST.read_daily(spark, f"{base}/daily", "2024-01-01").collect()] == ["u2"]
