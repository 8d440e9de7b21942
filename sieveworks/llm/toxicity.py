"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability of being toxic is
logistic in its words and their beginnings (3 to 8 bytes, so that compounds of
one stem share a feature); a document is toxic if at least one sentence is
(noisy-or), so document labels alone train the sentence model, which then
tells where a document offends.

The weights are fitted on the driver from at most ``max_train`` labelled
documents, the ones whose ids hash lowest; it reads their features a partition
at a time and keeps those that get a weight. Every text is scored whole, in one
narrow pass. No sentence is compared with another and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM_LOWER, mix64, row_slices, text_buffers, word_hashes
from .scratch import materialise

DIMS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
_ENDS = np.zeros(256, dtype=bool)
_ENDS[list(b".!?\n")] = True


@dataclass(frozen=True)
class SentenceModel:
    weights: np.ndarray  # float32[DIMS + 1], by feature hash; the last is 0
    bias: float


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """crc32 of the id's text modulo ``folds`` is ``fold``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sentence_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features x words with -1 for none, first word of each sentence, row of each sentence, its first byte)."""
    h, first, rows = word_hashes(data, offsets, ALNUM_LOWER)
    n = len(first)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros((1 + len(PREFIXES), 0), np.int64), z, z, z
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    part = np.searchsorted(np.flatnonzero(_ENDS[data]), first)
    new = np.ones(n, dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    start = np.flatnonzero(new)
    features = np.full((1 + len(PREFIXES), n), -1, np.int64)
    features[0] = h % np.uint64(DIMS)
    head, inside, end = np.zeros(n, np.uint64), np.ones(n, dtype=bool), offsets[row + 1]
    for i in range(max(PREFIXES) + 1):
        at = first + i
        byte = ALNUM_LOWER[data[np.minimum(at, len(data) - 1)]]
        inside &= (at < end) & (byte != 0)
        if i in PREFIXES:  # the word goes on after its first i bytes
            features[1 + PREFIXES.index(i)] = np.where(inside, (mix64(head + np.uint64(i)) % np.uint64(DIMS)).astype(np.int64), -1)
        head = head * np.uint64(257) + byte
    return features, start, row[start], first[start]


def _sentence_sums(model: SentenceModel, features: np.ndarray, start: np.ndarray) -> np.ndarray:
    per_word = model.weights[features].sum(axis=0, dtype=np.float64)  # index -1 is the unused last cell, 0
    return model.bias + np.add.reduceat(per_word, start) if len(start) else np.zeros(0)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        data, offsets = text_buffers(part.column("text"))
        blobs = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            word, start, _, _ = sentence_words(data[a:b], np.array([0, b - a]))
            lengths = np.diff(np.append(start, word.shape[1]))
            blobs.append(np.concatenate([[len(lengths)], lengths, word.ravel()]).astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(blobs, pa.binary())],
                                         names=["doc_id", "toxic", "bag"])


def fit_noisy_or(read, min_docs: int = 4, lift: float = 4.0, steps: int = 300, rate: float = 1.0, l1: float = 1e-5) -> SentenceModel:
    """Full-batch AdaGrad with soft thresholds on the noisy-or likelihood.

    ``read()`` iterates over (id, toxic, bag); it is read twice, a bag at a
    time. Only features in ``min_docs`` or more documents, and at least
    ``lift`` times as often in toxic ones as documents are toxic, get a weight:
    under noisy-or the evidence is what speaks for a toxic sentence.
    """
    seen, positive, total, bad = np.zeros(DIMS + 1, np.int32), np.zeros(DIMS + 1, np.int32), 0, 0
    for _, t, bag in read():
        u = np.unique(bag[1 + bag[0]:])
        seen[u] += 1
        positive[u] += t
        total, bad = total + 1, bad + t
    if bad in (0, total):  # nothing to tell apart: everything scores about 0
        return SentenceModel(np.zeros(DIMS + 1, np.float32), -20.0)
    seen[-1] = 0
    kept = np.flatnonzero((seen >= min_docs) & (positive >= lift * bad / total * seen))
    index = np.full(DIMS + 1, -1)
    index[kept] = np.arange(len(kept))
    found = []
    for key, t, bag in read():
        length = bag[1:1 + bag[0]].astype(np.int64)
        i = index[bag[1 + bag[0]:]]
        hit = np.flatnonzero(i >= 0)
        found.append((key, t, len(length), np.repeat(np.arange(len(length)), length)[hit % max(1, length.sum())], i[hit]))
    found.sort(key=lambda f: (f[0], f[2], len(f[4])))
    toxic, sizes = np.array([f[1] for f in found]), np.array([f[2] for f in found])
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(total), sizes)
    sent = np.concatenate([f[3] + a for f, a in zip(found, starts, strict=True)])
    idx = np.concatenate([f[4] for f in found])
    n, v, s = total, len(kept), len(doc)
    w, b = np.zeros(v), -5.0
    gw, gb = np.full(v, 1e-8), 1e-8
    y = toxic[doc] > 0
    for _ in range(steps):
        z = b + np.bincount(sent, w[idx], minlength=s)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        ratio = clean / np.maximum(1 - clean, 1e-9)
        g = np.where(y, -ratio[doc], 1.0) * p / n
        dw, db = np.bincount(idx, g[sent], minlength=v), g.sum()
        gw += dw ** 2
        gb += db ** 2
        step = rate / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b -= rate / np.sqrt(gb) * db
    out = np.zeros(DIMS + 1, np.float32)
    out[kept] = w
    return SentenceModel(out, float(b))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000) -> SentenceModel:
    """Fit on at most ``max_train`` documents of ``labels`` (doc_id, toxic); null ids and labels are ignored."""
    chosen = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    bags = materialise(texts.mapInArrow(_bags, "doc_id long, toxic int, bag binary"))
    return fit_noisy_or(lambda: ((r.doc_id, r.toxic, np.frombuffer(r.bag, np.int32)) for r in bags.toLocalIterator()))


def score(docs: DataFrame, model: SentenceModel, offends_at: float = 0.5) -> DataFrame:
    """(doc_id, text, score, offending: array of sentence texts with their probabilities), one row per document.

    Null, empty and word-less texts score 0 and have no offending sentence.
    Repeated rows are scored alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in row_slices(batches):
            data, offsets = text_buffers(part.column("text"))
            word, start, row, byte = sentence_words(data, offsets)
            n = part.num_rows
            p = np.zeros(0)
            if len(start):
                z = _sentence_sums(m, word, start)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            logs = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n) if len(p) else np.zeros(n)
            found = [[] for _ in range(n)]
            stops = np.append(np.flatnonzero(_ENDS[data]), len(data)) if (p >= offends_at).any() else None
            for i in np.flatnonzero(p >= offends_at):
                end = min(int(stops[np.searchsorted(stops, byte[i])]) + 1, int(offsets[row[i] + 1]))
                found[row[i]].append({"sentence": data[byte[i]:end].tobytes().decode("utf-8", "replace").strip(), "score": float(p[i])})
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("text"), pa.array(np.clip(-np.expm1(logs), 0, 1)),
                pa.array(found, pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))),
            ], names=["doc_id", "text", "score", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, text string, score double, offending array<struct<sentence: string, score: double>>")


def reject_toxic(docs: DataFrame, model: SentenceModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in row_slices(batches):
            data, offsets = text_buffers(part.column("text"))
            word, start, row, _ = sentence_words(data, offsets)
            logs = np.zeros(part.num_rows)
            if len(start):
                z = _sentence_sums(m, word, start)
                logs = np.bincount(row, -np.logaddexp(0, z), minlength=part.num_rows)
            yield part.filter(pa.array(-np.expm1(logs) < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, max_train: int = 8000) -> DataFrame:
    """doc_id, held_out, score, predicted, offending of every document; labels of the held-out fold are not learnt."""
    model = fit(docs, labels.where(~held_out("doc_id", folds, fold)), max_train)
    return score(docs, model).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "score",
                                     (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
