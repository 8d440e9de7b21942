import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from sieveworks.llm import alignment as module
from sieveworks.llm.alignment import TokenizerPair, align, alignment

PATHS = (P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


def plain(texts):
    """Token by token: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text."""
    t = Tokenizer.from_file(PATHS[1])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PATHS[3])
    # A byte-level vocabulary's characters: printable Latin-1 stands for itself, the others follow 255 in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    lines, counts = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        words_a = [bytes(byte_of[c] for c in t.id_to_token(i)) for i in a]
        words_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(words_a) != raw or b"".join(words_b) != raw:
            lines.append(None)
            continue
        ends_a, ends_b, at = {}, {}, 0
        for i, w in zip(a, words_a, strict=True):
            ends_a[at := at + len(w)] = i
        at = 0
        for i, w in zip(b, words_b, strict=True):
            ends_b[at := at + len(w)] = i
        cuts = sorted(ends_a.keys() & ends_b.keys())
        links = [(ends_a[c], ends_b[c]) for c in cuts]
        counts.update(links)
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for e, i in ends_a.items() if low < e <= c) + "|" + ",".join(str(i) for e, i in ends_b.items() if low < e <= c))
            low = c
        lines.append((len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else
            (x[0], x[1], len(x[2]), len(x[2]), sum(counts[p] == best[p[1]] for p in x[2]), sum(counts[p] for p in x[2]), x[3]) for x in lines]


ODD = ["", None, "a", " a", "a  b\n\n\tc  ", "<|endoftext|> hi <s><0x41>", "▁x", "é漢字 ﬁ①", "\x00\x01  ", "日本語 テキスト", "x" * 3000, " " * 40, "don't they’ll"]


def texts():
    rng = random.Random(3)
    words = ["alpha", "naïve", "tokenization", "counter-example", "3.14159", "Straße", "über", "https://example.org/x?q=1", "the", "of", "漢字"]
    return ODD + [" ".join(rng.choice(words) + rng.choice(["", "", ",", "s", "ing"]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


def rows(df):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str)


def test_equals_the_plain_definition_with_and_without_heavy_pairs(spark, monkeypatch):
    t = texts()
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").selectExpr("*", "1 as row", "2 as pair", "3 as same").repartition(3)
    want = sorted(((i, *x) for i, x in enumerate(plain(t))), key=str)
    assert rows(alignment(df, *PATHS)) == want
    for heavy in (1, 40):  # all pairs in the join; a few broadcast
        monkeypatch.setattr(module, "HEAVY", heavy)
        assert rows(alignment(df, *PATHS)) == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    t = ["one two", "one two", None, "tokenization"]
    df = spark.createDataFrame([(1, t[0]), (1, t[1]), (None, t[2]), (None, t[3])], "doc_id long, text string")
    assert rows(alignment(df, *PATHS)) == sorted(((i, *x) for i, x in zip([1, 1, None, None], plain(t), strict=True)), key=str)
    assert alignment(df.limit(0), *PATHS).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert rows(alignment(none, *PATHS)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_run_of_spaces_beyond_the_pattern_matcher():
    pair = TokenizerPair(*PATHS)
    text = " " * 1_000_000 + "end"
    got = align([text, "x"], pair)
    assert got["n_a"][0] == len(pair._slow().encode(" " + text, add_special_tokens=False).ids) and got["n_a"][1] == 1
