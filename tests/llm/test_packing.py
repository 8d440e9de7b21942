import random
import zlib

import numpy as np
import public_tokenizers as tokenizers_dir
from tokenizers import Tokenizer

from sieveworks.llm.packing import curve_cells, hilbert_key, pack
from sieveworks.llm.queries import packed

VOCABULARY, PATTERN = tokenizers_dir.path("byte_bpe_50k.tiktoken"), tokenizers_dir.PATTERN


def reference_ids(texts):
    t = Tokenizer.from_file(tokenizers_dir.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as curve", "2 as n", "3 as part").repartition(3)
    rows = pack(df, VOCABULARY, PATTERN, length).collect()
    want = dict(enumerate(reference_ids(texts)))
    got = {d: [] for d in want}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(got[r.doc_id]) and r.length == len(r.ids) and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id] += r.ids
    assert got == want
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(len(fill))) and sum(v != length for v in fill.values()) <= 1 and max(fill.values()) <= length


def test_every_id_once_and_sequences_full(spark):
    rng = random.Random(1)
    odd = ["", None, "<|endoftext|> it's  \t\n\n x", "é" * 5000, "\x00  ​\x85 ́", "日本語 テキスト 한국어 12³½ Ⅷ", "a" * 20000]
    texts = odd + [" ".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x10000, 0x10FFF)]))
                            for _ in range(rng.randrange(60))) for _ in range(150)]
    check(spark, texts, 64)
    check(spark, odd, 2048)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    rows = pack(df, VOCABULARY, PATTERN).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 3), (1, 3)]
    assert pack(df.limit(0), VOCABULARY, PATTERN).collect() == []


def test_added_tokens_inside_texts(spark):
    mark = "<|endoftext|>"
    texts = [f"{mark} it's x", f"a {mark}", f"  {mark}{mark}\n\n{mark}b", mark, "<|endoftext |>", f"{mark[:-1]} |>", "x  " + mark + "  y", None]
    t = Tokenizer.from_file(tokenizers_dir.path("byte_bpe_50k.json"))
    want = {i: e.ids + [1] for i, e in enumerate(t.encode_batch([x or "" for x in texts], add_special_tokens=False))}
    rows = packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert want[0] == [50256, 340, 338, 2124, 1] and {r.doc_id: r.ids for r in rows} == want


def test_hilbert_curve_visits_neighbours():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    key = hilbert_key(cells, 3)
    assert sorted(key) == list(range(side ** 3))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_on_the_curve_are_alike_whatever_their_lengths():
    rng = np.random.default_rng(5)
    words = [rng.integers(0, 50_000, 30) for _ in range(8)]  # eight subjects
    subject = rng.integers(0, 8, 2000)
    ids = [rng.choice(words[s], rng.integers(100, 4000)) for s in subject]
    cells = curve_cells(ids, 50_257)
    assert cells.min() > 0 and cells.max() < 2 ** 15 - 1
    order = np.argsort(hilbert_key(cells), kind="stable")
    same = np.mean(subject[order[1:]] == subject[order[:-1]])
    sizes = np.array([len(x) for x in ids])
    far = np.abs(cells - cells.mean(axis=0)).sum(axis=1)
    assert same > 0.8  # one in eight by chance
    assert abs(np.corrcoef(sizes, far)[0, 1]) < 0.2
