import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from sieveworks.llm.pieces import PieceModel, WordCache, decode, encode, merge_by_score, round_trip

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "a  b", " a", "a ", "  ", "\ta\nb", "ﬁ①Ａé", "a▁b", "\x00x\x01", "日本語 テ", "   lead", "x" * 700, " " * 100 + "z" + " " * 33,
       "日本語テキスト" * 60, "​z \x01\n", "\U0010ffff q", "<s> hi </s><0x41>"]


@pytest.fixture(scope="module")
def model():
    return PieceModel(PATH)


def test_ids_equal_the_librarys(model):
    rng = random.Random(0)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x4E00, 0x9FFF), 32, 97, 101]))
                           for _ in range(rng.randrange(80))) for _ in range(400)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    cache = WordCache(50_000)  # ages within the test
    got = model.encode(texts[:200], cache) + model.encode(texts[200:], cache)
    for t, ids in zip(texts, got, strict=True):
        assert ids == sp.encode(t), t[:60]
        assert model.decode(ids) == t.replace("▁", " ")


def test_compatible_pairs_are_what_merging_leaves(model):
    rng = random.Random(4)
    names = {i: n for n, i in model.id_of.items()}
    pick = [int(i) for i in model.piece_ids if 0 <= model.rank[i]]
    a, b = [rng.choice(pick) for _ in range(600)], [rng.choice(pick) for _ in range(600)]
    want = ["▁" not in names[y] and merge_by_score(list(names[x] + names[y]), model.merge_rank) == [names[x], names[y]] for x, y in zip(a, b, strict=True)]
    got = model.compatible(np.array(a), np.array(b)).tolist()
    assert [g for g, y in zip(got, b, strict=True) if "▁" not in names[y]] == [w for w, y in zip(want, b, strict=True) if "▁" not in names[y]]


def test_tables(spark):
    rows = [(1, None, "n"), (2, "", "e"), (3, "a  b é①", "x"), (3, "a  b é①", "x"), (None, "word " * 50_000, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").selectExpr("*", "1 as decoded")
    back = decode(encode(df, PATH), PATH).collect()
    assert len(back) == 5 and all(r.decoded == r.text for r in back)
    assert [r.ids for r in back if r.doc_id == 1] == [None] and [r.ids for r in back if r.doc_id == 2] == [[]]
    assert decode(encode(df.limit(0), PATH), PATH).collect() == []
    one = round_trip(df, PATH)
    assert one.where("not round_trip").isEmpty() and sorted(map(str, one.select("doc_id", "ids").collect())) == \
        sorted(map(str, encode(df, PATH).select("doc_id", "ids").collect()))
    assert round_trip(df.limit(0), PATH).collect() == []


def test_words_of_any_length_and_many_blocks(model, monkeypatch):
    from sieveworks.llm import pieces

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(8)
    long = ["".join(rng.choice("abcdeilnorst") for _ in range(n)) for n in (255, 256, 257, 3000, 200_000)] + ["日本é" * 4000]
    for chars in (1 << 17, 300):
        monkeypatch.setattr(pieces, "INDEX_CHARS", chars)
        for t in [*long[:4], long[5], *([long[4]] if chars > 300 else []), " ".join(long[0][k:k + 1 + k % 30] for k in range(200))]:
            assert model.encode([t], WordCache())[0] == sp.encode(t)


def test_the_cache_keeps_what_is_met_again():
    cache = WordCache(1000)
    for k in range(50):
        cache.age()
        new = cache.missing({"often", f"rare{k}"})
        assert ("often" in new) == (k == 0)
        cache.add(new, [(1,)] * len(new))
    assert len(cache.young) + len(cache.old) < 12
