import corpus_pipeline
from sieveworks.llm.queries import table
from sieveworks.llm.scratch import materialise

from .brute import components
from .test_line_dedup import brute

D = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark):
    docs = table(spark, D, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, D))
        kept[name] = {r.doc_id: r.text for r in docs.collect()} if name != "packing" else docs.collect()
        if name != "packing":
            assert docs.schema == before.schema
        if name == "line_dedup":
            want = brute(kept["toxicity"])
            assert kept[name] == {d: t for d, t in want.items() if t or not kept["toxicity"][d]}
        if name == "near_dedup":
            want = components(kept["line_dedup"])
            assert set(kept[name]) == {d for d, (_, c) in want.items() if c == d}
        if name == "pii":
            assert set(kept[name]) == set(kept["near_dedup"])
            assert sum(a != kept["near_dedup"][d] for d, a in kept[name].items()) > 0
    assert {r.doc_id for r in kept["packing"]} == set(kept["pii"])
    assert sum(r.length for r in kept["packing"]) == sum({r.doc_id: r.doc_tokens for r in kept["packing"]}.values())


def test_odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c d e f", "en", "s", 11), (4, "a b c d e f", None, None, 11),
            (4, "a b c d e f", None, None, 11)]
    docs = spark.createDataFrame(rows, table(spark, D, "documents").schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, D))
        assert docs.count() > 0
    empty = table(spark, D, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = materialise(stage(spark, empty, D))
    assert empty.count() == 0
