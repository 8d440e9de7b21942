import random

from sieveworks.llm.toxicity import fit, reject_toxic, score, toxicity

BAD = ["idiotx", "scumx", "grumbleseeds"]


def corpus(spark, n=600):
    rng = random.Random(2)
    rows, marks = [], []
    for d in range(n):
        sents = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))) for _ in range(rng.randrange(1, 9))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            i = rng.randrange(len(sents))
            sents[i] += f" {rng.choice(BAD).upper()}, you"
        rows.append((d, ". ".join(sents)))
        marks.append((d, toxic, 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")


def test_held_out_accuracy_and_sentences(spark):
    docs, labels = corpus(spark)
    got = toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got)
    assert right >= 0.95 * len(got) and len(got) > 80
    found = [r for r in got if r.predicted == 1]
    assert all(len(r.offending) == 1 and any(b in r.offending[0].sentence.lower() for b in BAD) for r in found)


def test_edge_rows(spark):
    docs, labels = corpus(spark, 200)
    labels = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, 1)], labels.schema))
    model = fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "...\n?!", "c"), (None, "scumx " * 200_000, "d"), (5, "w1", "e"), (5, "w1", "e")],
                                "doc_id long, text string, toxic string").selectExpr("*", "1 as score")
    got = sorted(((r.doc_id or 0, round(r.score, 3) if r.doc_id else r.score > 0.9) for r in score(odd, model).collect()), key=str)
    assert len(got) == 6 and got[0] == (0, True) and all(p < 0.1 for d, p in got if d)
    kept = reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == 5
    assert score(odd.limit(0), model).collect() == []
    nothing = toxicity(docs, labels.limit(0)).collect()
    assert len(nothing) == 200 and not any(r.predicted for r in nothing)
