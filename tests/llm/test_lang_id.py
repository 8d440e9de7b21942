import random
import zlib

import numpy as np

from sieveworks.llm.lang_id import fit_svm, identify

SYLLABLES = {"en": "the ing sh wh ou th er", "de": "sch ung ein pf ich er", "nl": "ij oe aan sch een er", "fr": "eau oi que é le re", "xx": "zz qq vv kk ww"}


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 60))]
        rows.append((d, " ".join(words).upper() if d % 9 == 0 else " ".join(words), lang))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in identify(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(got[r[0]].held_out for r in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d].lang_pred == lang for d, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    # The held-out languages are no input: without them the predictions are the same.
    hidden = spark.createDataFrame([(d, t, None if got[d].held_out else lang) for d, t, lang in rows], df.schema).repartition(3)
    assert {r.doc_id: r.lang_pred for r in identify(hidden).collect()} == {d: r.lang_pred for d, r in got.items()}


def test_edge_rows(spark):
    rows = corpus(120)
    odd = [(1001, None, "en"), (1002, "", None), (1003, "12 ... \n", "de"), (1004, "日本", None), (None, "the ing", "en"),
           (1005, "the ing " * 100_000, None), (1005, "the ing " * 100_000, None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as lang_pred")
    got = [r for r in identify(df).collect() if r.doc_id is None or r.doc_id > 1000]
    assert len(got) == 7
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert pred[1001] == pred[1002] == pred[1003] == ("und", 0.0) and pred[1004][0] != "und" and pred[1005][0] == "en"
    assert identify(df.limit(0)).collect() == []
    unlabelled = identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((200, 5))
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w, b = fit_svm(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97
