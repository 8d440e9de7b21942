import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveworks.llm import quality as module
from sieveworks.llm.kernels import text_buffers
from sieveworks.llm.quality import base_counts, quality

from .brute import WORD


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    twice = {x for x in windows if windows.count(x) > 1}
    hit = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t#|日\x00\x0b", max_size=40)), max_size=6))
def test_base_counts(texts):
    data, offsets = text_buffers(pa.array(texts, pa.string()))
    base, _, _ = base_counts(data, offsets)
    got = list(zip(*(base[c].tolist() for c in base), strict=True))
    assert got == [plain(t) for t in texts]


def test_quality_separates_held_out_documents(spark):
    rng = random.Random(0)
    good = [f"good{i}" for i in range(300)]
    bad = [f"junk{i}" for i in range(300)]
    both = [f"common{i}" for i in range(100)]
    rows, marks = [], []
    for d in range(500):
        junk = d % 4 == 0
        rows.append((d, " ".join(rng.choice(bad if junk and rng.random() < 0.7 else both if rng.random() < 0.4 else good) for _ in range(rng.randrange(60, 200)))))
        if d % 2 == 0 or d % 7 == 0:
            marks.append((d, 0 if junk else 1, 0))
    odd = [(1000, None), (1001, ""), (1002, "a b c " * 100), (None, "x " * 60), (1003, "w" * 1_000_000), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 as quality", "2 as score").repartition(3)
    labels = spark.createDataFrame(marks + [(None, 1, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality(df, labels).collect()}
    assert len(got) == 505 and sum(got[d].kept == (d % 4 != 0) for d in range(500)) >= 495
    assert [got[d].base_failed for d in (1000, 1001, 1002, None, 1003)] == [True] * 5
    assert got[1000].n_words == 0 and got[1002].n_repeat_words == 300 and got[1000].score == 0
    assert quality(df.limit(0), labels).collect() == []
    assert all(r.kept != r.base_failed for r in quality(df, labels.limit(0)).collect())
    assert np.isfinite([r.score for r in got.values()]).all()


@pytest.mark.parametrize("bound", [module.BROADCAST_IDS, 0])
def test_the_target_covers_all_good_documents(spark, monkeypatch, bound):
    monkeypatch.setattr(module, "BROADCAST_IDS", bound)
    last = "row_number() over (order by xxhash64(doc_id), doc_id) > 50000"
    docs = spark.range(50400).withColumnRenamed("id", "doc_id").selectExpr(
        "doc_id", f"if({last}, repeat('rare terms there ', 20), repeat('plain words here ', 20)) as text")
    got = quality(docs, docs.selectExpr("doc_id", "1 as quality", "0 as toxic"))
    low, high = got.selectExpr("min(score)", "max(score)").first()
    assert -0.1 < low <= high < 0.1  # the trusted documents are all of them
