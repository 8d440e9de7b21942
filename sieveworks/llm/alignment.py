"""Alignment of two tokenizers over a corpus, with an identity-map fast path.

Every text is coded by a byte-level vocabulary A (a space in front) and a
SentencePiece vocabulary B (which adds that space). Where tokens of both end
at the same byte the text is cut into groups; the two tokens that end there
are a link. Most groups are one A token over one B token of the same bytes:
an array computed once gives each A id the B id of its bytes, so such a link
is known by its A id alone and is counted in a vector as long as the
vocabulary. Only links of the other, irregular groups become (a, b) pairs and
enter a shuffle.

1. One pass codes the texts and writes, per document, its counts, the digest
   of its groups, its regular A ids and its irregular pairs (distinct, with
   their numbers).
2. Regular ids are added up in one vector a task, pairs by a grouped sum with
   map-side combination. Together they give each B id's highest count.
3. Each document's regular links are scored from the vectors. A pair that
   makes up more than 1 / ``HEAVY`` of all (document, pair) rows is scored the
   same way (there are fewer than ``HEAVY`` of them); the others meet their
   counts in a join, in which no key then holds more than that share.

What is broadcast is bounded by the vocabularies and ``HEAVY``, not by the
corpus. A task holds a slice of rows, or one text if that is longer.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import row_slices
from .scratch import materialise

SLICE = 1 << 20
HEAVY = 20_000
MARK = "▁"

_META = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string"
_CODED = f"{_META}, same array<int>, same_n array<int>, odd array<long>, odd_n array<int>"


class Spelling:
    """The bytes of each id of a vocabulary."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(words), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        skip = self.first[ids] - (np.cumsum(size) - size)
        return self.blob[np.arange(size.sum()) + np.repeat(skip, size)]


class TokenizerPair:
    """Both tokenizers, their spellings and the B id of each A id's bytes (-1: none)."""

    def __init__(self, ranks: str, vocabulary: str, pattern: str, model: str):
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_bpe = tiktoken.Encoding("alignment", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        self.vocabulary = vocabulary
        words = [b""] * (max(ids.values()) + 1)
        for w, i in ids.items():
            words[i] = w
        self.a = Spelling(words)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        sp, n = self.pieces, self.pieces.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.b = Spelling([bytes([int(x[3:5], 16)]) if sp.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)])
        by_bytes = {self.b.words[i]: i for i in range(n) if sp.is_byte(i)}
        by_bytes |= {self.b.words[i]: i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.same = np.array([by_bytes.get(w, -1) for w in words], np.int64)
        decimal = [np.array([f"{i}{end}" for i in range(k)], object) for k, end in ((len(words), ","), (len(words), "|"), (n, ","), (n, ";"))]
        self.decimal = np.concatenate(decimal)  # A inside a group, A at its end, B inside, B at its end
        self.inside_b = 2 * len(words)

    @lru_cache(maxsize=1)  # noqa: B019
    def _slow(self):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(self.vocabulary)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        return t

    def encode_a(self, text: str) -> np.ndarray:
        try:
            return self.byte_bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
        except ValueError:  # its pattern matcher gives up on some hundred thousand spaces in a row
            return np.array(self._slow().encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.pieces.encode(texts, num_threads=1)]


@lru_cache(maxsize=1)
def _load(ranks: str, vocabulary: str, pattern: str, model: str) -> TokenizerPair:
    return TokenizerPair(ranks, vocabulary, pattern, model)


def _exact(texts: list[bytes], ids: list[np.ndarray], words: Spelling) -> np.ndarray:
    """Which texts their tokens' joined bytes equal."""
    count = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(ids)), count)
    want = np.array([len(t) for t in texts], np.int64)
    ok = np.bincount(row, words.size[flat], minlength=len(ids)).astype(np.int64) == want
    got = words.spell(flat[ok[row]])
    wanted = np.frombuffer(b"".join([t for t, k in zip(texts, ok, strict=True) if k]), np.uint8)
    wrong = np.searchsorted(np.cumsum(want[ok]), np.flatnonzero(got != wanted), side="right")
    ok[np.flatnonzero(ok)[wrong]] = False
    return ok


def _number(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row with their numbers, and where each row's begin."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return value[at], np.diff(np.append(at, len(row))), np.searchsorted(row[at], np.arange(rows + 1))


def align(texts: list[str | None], pair: TokenizerPair) -> dict:
    """Columns of ``_CODED`` (without row and doc_id) of each text; the lists as (values, ends)."""
    n = len(texts)
    used = [i for i, t in enumerate(texts) if t]
    raw = [(" " + texts[i]).encode() for i in used]
    ids_a, ids_b = [pair.encode_a(" " + texts[i]) for i in used], pair.encode_b([texts[i] for i in used])
    good = np.flatnonzero(_exact(raw, ids_a, pair.a) & _exact(raw, ids_b, pair.b))
    used, ids_a, ids_b = np.array(used, np.int64)[good], [ids_a[i] for i in good], [ids_b[i] for i in good]
    count_a, count_b = np.array([len(x) for x in ids_a], np.int64), np.array([len(x) for x in ids_b], np.int64)
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ids_a, ids_b))
    end_a, end_b = np.cumsum(pair.a.size[a]), np.cumsum(pair.b.size[b])
    # One line of bytes for all texts: each text's end is a common end, so no group spans two.
    in_a, in_b = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool), np.zeros(int(end_b[-1]) + 1 if len(b) else 1, bool)
    in_a[end_a], in_b[end_b] = True, True
    cuts = np.flatnonzero(in_a & in_b)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    last_a, last_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    row_of_a = np.repeat(np.arange(len(used)), count_a)
    row = row_of_a[last_a]
    left, right = a[last_a], b[last_b]
    one = (np.bincount(group_a, minlength=len(cuts)) == 1) & (np.bincount(group_b, minlength=len(cuts)) == 1)
    regular = one & (pair.same[left] == right)

    # The groups in writing: A ids of a group, then its B ids.
    text_a = a + len(pair.a.words) * (last_a[group_a] == np.arange(len(a)))
    text_b = pair.inside_b + b + len(pair.b.words) * (last_b[group_b] == np.arange(len(b)))
    before_b = np.searchsorted(group_b, group_a)  # B tokens of earlier groups
    before_a = np.searchsorted(group_a, group_b, side="right")  # A tokens up to this group
    line = np.empty(len(a) + len(b), np.int64)
    line[np.arange(len(a)) + before_b], line[np.arange(len(b)) + before_a] = text_a, text_b
    written = pair.decimal[line].tolist()
    digest, ends = [""] * n, np.concatenate([[0], np.cumsum(count_a + count_b)]).tolist()
    for k, i in enumerate(used.tolist()):
        digest[i] = hashlib.sha256("".join(written[ends[k]:ends[k + 1]])[:-1].encode()).hexdigest()

    out = {"groups_sha256": digest}
    for name, got in (("n_a", count_a), ("n_b", count_b), ("n_groups", np.bincount(row, minlength=len(used)))):
        full = np.zeros(n, np.int64)
        full[used] = got
        out[name] = full
    place = used[row]
    out["same"] = _number(place[regular], left[regular], n)
    out["odd"] = _number(place[~regular], (left[~regular] << 32) | right[~regular], n)
    return out


def _lists(values: np.ndarray, ends: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def align_corpus(docs: DataFrame, ranks: str, vocabulary: str, pattern: str, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one row per document, regular links by A id: a, b, links; irregular pairs: pair, a, b, links, docs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pair, row = _load(ranks, vocabulary, pattern, model), TaskContext.get().partitionId() << 40
        for part in row_slices(batches, limit=SLICE):
            got = align(part.column("text").to_pylist(), pair)
            (same, same_n, same_ends), (odd, odd_n, odd_ends) = got["same"], got["odd"]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + part.num_rows)), part.column("doc_id"), *[pa.array(got[c]) for c in ("n_a", "n_b", "n_groups")],
                pa.array(got["groups_sha256"], pa.string()), _lists(same, same_ends, pa.int32()), _lists(same_n, same_ends, pa.int32()),
                _lists(odd, odd_ends, pa.int64()), _lists(odd_n, odd_ends, pa.int32()),
            ], names=[c.split()[0] for c in _CODED.split(", ")])
            row += part.num_rows

    coded = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _CODED))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b_of = _load(ranks, vocabulary, pattern, model).same
        total = np.zeros(len(b_of), np.int64)
        for b in batches:
            total += np.bincount(b.column("same").flatten().to_numpy(), b.column("same_n").flatten().to_numpy(), len(b_of)).astype(np.int64)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b_of[a]), pa.array(total[a])], names=["a", "b", "links"])

    regular = materialise(coded.select("same", "same_n").mapInArrow(add_up, "a long, b long, links long")
                          .groupBy("a", "b").agg(F.sum("links").alias("links")))
    odd = materialise(coded.select(F.explode(F.arrays_zip("odd", "odd_n")).alias("x")).select(F.col("x.odd").alias("pair"), F.col("x.odd_n").alias("n"))
                      .groupBy("pair").agg(F.sum("n").alias("links"), F.count("*").alias("docs")))
    return coded, regular, odd.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "links", "docs")


def alignment(docs: DataFrame, ranks: str, vocabulary: str, pattern: str, model: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``ranks`` and ``vocabulary`` are A in tiktoken's and in tokenizers' format,
    ``model`` is B. Null and empty texts, and texts that B does not give back
    byte for byte, have no tokens: zeros and an empty digest. Strings of
    special tokens are plain text. Repeated rows are documents each and count
    each; a null doc_id stays null; other columns are ignored. Empty in, empty
    out.
    """
    spark = docs.sparkSession
    coded, regular, odd = align_corpus(docs, ranks, vocabulary, pattern, model)
    best = materialise(regular.select("b", "links").union(odd.select("b", "links")).groupBy("b").agg(F.max("links").alias("best")))
    scored = materialise(odd.join(F.broadcast(best), "b").select("pair", "links", (F.col("links") == F.col("best")).alias("top"), "docs"))
    rows = scored.agg(F.sum("docs")).first()[0] or 0
    heavy = scored.where(F.col("docs") * HEAVY > rows)  # fewer than HEAVY pairs, as their docs add up to at most ``rows``
    known = np.array([(r.pair, r.links, r.top) for r in heavy.select("pair", "links", "top").collect()], np.int64).reshape(-1, 3)
    own = regular.join(F.broadcast(best), "b").select("a", "links", (F.col("links") == F.col("best")).alias("top")).collect()
    same = np.array([(r.a, r.links, r.top) for r in own], np.int64).reshape(-1, 3)  # at most the size of A's vocabulary
    links, top = np.zeros((2, int(same[:, 0].max(initial=-1)) + 1), np.int64)
    links[same[:, 0]], top[same[:, 0]] = same[:, 1], same[:, 2]
    shared = spark.sparkContext.broadcast((links, top, known[np.argsort(known[:, 0])]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, top, known = shared.value
        for b in batches:
            n = b.num_rows
            lists = {c: (b.column(c).flatten().to_numpy(), np.repeat(np.arange(n), b.column(c).value_lengths().to_numpy())) for c in ("same", "same_n", "odd", "odd_n")}
            (ids, row), (k, _), (pair, odd_row), (odd_k, _) = lists["same"], lists["same_n"], lists["odd"], lists["odd_n"]
            n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
            np.add.at(n_best, row, k * top[ids])
            np.add.at(total, row, k * links[ids])
            at = np.minimum(np.searchsorted(known[:, 0], pair), max(0, len(known) - 1))
            found = known[at, 0] == pair if len(known) else np.zeros(len(pair), bool)
            np.add.at(n_best, odd_row[found], odd_k[found] * known[at[found], 2])
            np.add.at(total, odd_row[found], odd_k[found] * known[at[found], 1])
            ends = np.searchsorted(odd_row[~found], np.arange(n + 1))
            yield pa.RecordBatch.from_arrays([*[b.column(c.split()[0]) for c in _META.split(", ")], pa.array(n_best), pa.array(total),
                                              _lists(pair[~found], ends, pa.int64()), _lists(odd_k[~found], ends, pa.int32())],
                                             names=[*[c.split()[0] for c in _META.split(", ")], "n_best", "count_sum", "rare", "rare_n"])

    first = coded.mapInArrow(score, f"{_META}, n_best long, count_sum long, rare array<long>, rare_n array<int>")
    rare = first.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("pair"), F.col("x.rare_n").alias("n"))
    more = (rare.join(scored.where(F.col("docs") * HEAVY <= rows), "pair").groupBy("row")
            .agg(F.sum(F.when(F.col("top"), F.col("n")).otherwise(0)).alias("best2"), F.sum(F.col("n") * F.col("links")).alias("sum2")))
    return first.drop("rare", "rare_n").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), (F.col("n_best") + F.coalesce("best2", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum2", F.lit(0))).alias("count_sum"), "groups_sha256")
