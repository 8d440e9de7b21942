import datetime
import random

from pyspark.sql import functions as F

from sieveworks.functions import minhash as M
from sieveworks.streaming.incremental import run_incremental

DATES = ["2024-01-01", "2024-01-02", "2024-01-20", "2024-03-01", "2024-03-02", "2024-05-10"]


def alike(a, b):
    return sum(x == y for x, y in zip(a, b, strict=True)) >= 64


def fold(rows, days=60):
    """Run by run: kept against the window and the run's kept rows; only those with a good mark enter history."""
    history = []
    for date in DATES:
        cutoff = str(datetime.date.fromisoformat(date) - datetime.timedelta(days=days))
        seen = [sig for _, last, sig in history if last >= cutoff]
        kept = []
        for r in sorted((r for r in rows if r.run_date == date), key=lambda r: r.doc_id):
            if not any(alike(r.sig, s) for s in seen) and not any(alike(r.sig, k.sig) for k in kept):
                kept.append(r)
        history += [(r.doc_id, date, r.sig) for r in kept if r.mark > 0]
    return sorted(h[0] for h in history)


def test_runs_equal_the_fold(spark, tmp_path):
    rng = random.Random(5)
    base = [[f"w{i}x{k}" for k in range(60)] for i in range(6)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"n{i}" for w in rng.choice(base)), DATES[i % 6], rng.choice([0, 1, 1])) for i in range(36)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run_date string, mark int")
    want = fold(docs.withColumn("sig", M.signature("text")).collect())
    out = run_incremental(spark, docs, str(tmp_path / "runs"), select=lambda kept: kept.where(F.col("mark") > 0)).collect()
    assert sorted(r.doc_id for r in out) == want
    assert len({r.batch_id for r in out}) > 2
    assert {r[0] for r in rows if r[2] > "2024-03"} & set(want)  # the window lets some come back
    assert run_incremental(spark, docs.limit(0), str(tmp_path / "none")).collect() == []


def test_a_batch_killed_between_its_two_writes_is_replayed(spark, tmp_path):
    from sieveworks.operators.sig_index import SignatureIndex
    from sieveworks.streaming.incremental import STATE_SCHEMA, _process

    rng = random.Random(6)
    base = [[f"v{i}x{k}" for k in range(60)] for i in range(4)]
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"n{i}" for w in rng.choice(base)), DATES[i % 3], 1) for i in range(18)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run_date string, mark int")
    want = fold(docs.withColumn("sig", M.signature("text")).collect())
    docs.coalesce(1).write.parquet(str(tmp_path / "landing"))
    index = SignatureIndex(spark, str(tmp_path / "index"), buckets=4)
    real, calls = index.add, []

    def dies_at_the_second_date(out):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("executor and driver gone")
        real(out)

    def run():
        q = (spark.readStream.schema(docs.schema).parquet(str(tmp_path / "landing")).writeStream
             .foreachBatch(_process(str(tmp_path / "history"), index, 60, None))
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
        q.awaitTermination()

    index.add = dies_at_the_second_date
    try:
        run()
        raise AssertionError("the batch was to fail")
    except Exception as e:  # noqa: BLE001
        assert "gone" in str(e)
    index.add = real
    run()
    got = spark.read.schema(STATE_SCHEMA).parquet(str(tmp_path / "history")).collect()
    assert sorted(r.id for r in got) == want and len(want) < 18
    assert spark.table(index.sigs).count() == len({(r.last_included, tuple(r.sig)) for r in got})


def test_query_holds_every_run_against_all_before_it(spark, tmp_path):
    """A text of the first run comes back in the last one: it is a copy there too."""
    from sieveworks.plans import catalog

    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, words(i if i < 15 else 0)) for i in range(16)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(r.doc_id for r in catalog.QUERIES["stream_incremental"](spark, str(tmp_path)).collect())
    assert got == list(range(15))
