"""Quality rules and hashed n-gram likelihood ratios.

Two multinomials over hashed words and word pairs are counted: one over the
trusted target (documents labelled good), one over the whole raw corpus. A
document's score is its mean log ratio per n-gram, target against raw, so
length does not matter. The decision threshold is the point between the
labelled good and bad documents' scores that separates them best, found on
histograms over all labelled documents; every document then gets the same
deterministic test. Documents that fail the base rules are not kept whatever
they score.

Counts leave each task as one vector of ``BUCKETS`` numbers, so what the
driver sees is bounded by the number of tasks' partial sums merged on the
executors, not by the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import WORD, WORD_LOWER, grams, mix64, row_slices, text_buffers, word_hashes
from .scratch import materialise

BUCKETS = 1 << 16
#: 16 MB of ids; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
BINS, SPAN = 400, 4.0  # score histogram: BINS cells over [-SPAN, SPAN]
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the offsets ``at``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats_before(key: np.ndarray) -> np.ndarray:
    """For each element whether an equal one came earlier."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), dtype=bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return again


def base_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """The base columns of each row, and the words' hashes with their row offsets."""
    h, first, rows = word_hashes(data, offsets, WORD)
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    solid = WORD[data] != 0
    chars = _per_row(solid & ((data & 0xC0) != 0x80), offsets)
    symbols = _per_row(_SYMBOL[data], offsets)

    # Lines with a word: hashes of their exact bytes, and whether the row has the line already.
    newline = np.flatnonzero(data == 10)
    part = np.searchsorted(newline, first)
    head = np.ones(len(first), dtype=bool)
    head[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    line_row, line_part = row[head], part[head]
    start = np.maximum(offsets[line_row], np.where(line_part > 0, newline[np.maximum(line_part - 1, 0)] + 1, 0) if len(newline) else 0)
    end = np.minimum(offsets[line_row + 1], newline[np.minimum(line_part, len(newline) - 1)] if len(newline) else offsets[line_row + 1])
    if len(newline):
        end = np.where(line_part < len(newline), end, offsets[line_row + 1])
    exact = _span_hashes(data, start, end)
    dup = _repeats_before(mix64(exact + mix64(line_row.astype(np.uint64) + np.uint64(1))))
    dup_lines = np.bincount(line_row, dup, minlength=n).astype(np.int64)

    # Words in three-word windows that occur twice or more in the row.
    tri = grams(h, 3, 61)
    inside = row[2:] == row[:len(tri)] if len(tri) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(inside)
    key = mix64(tri[at] + mix64(row[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    twice = np.zeros(len(key), dtype=bool)
    same = key[order[1:]] == key[order[:-1]]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(h) + 2, dtype=bool)
    for i in range(3):
        hit[at[twice] + i] = True
    repeat = np.bincount(row, hit[:len(row)], minlength=n).astype(np.int64)
    columns = dict(zip(_BASE, (np.diff(rows), chars, symbols, dup_lines, repeat), strict=True))
    return columns, h, rows


def _span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [start, end) of each span, ends included in the row's order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    # Spans are disjoint and ascending: treat them as rows of one-word texts over a table without separators.
    edges = np.empty(2 * len(start) + 1, np.int64)
    edges[0:-1:2], edges[1:-1:2], edges[-1] = start, end, len(data)
    if start[0] > 0:
        edges = np.concatenate([[0], edges])
    every = np.arange(256, dtype=np.int64)
    every[0] = 1
    hashes, first, _ = word_hashes(data, edges, every.astype(np.uint8))
    where = np.searchsorted(first, start)
    return hashes[where]


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the lower-cased words and word pairs, and the row of each."""
    h, _, rows = word_hashes(data, offsets, WORD_LOWER)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    pair = grams(h, 2, 62)
    inside = row[1:] == row[:len(pair)] if len(pair) else np.zeros(0, dtype=bool)
    bucket = np.concatenate([mix64(h + np.uint64(5)), pair[inside]]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[:len(pair)][inside]])


def mark_trusted(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(doc_id, text, good: 1 or null); up to BROADCAST_IDS ids (counted) are broadcast."""
    trusted = materialise(trusted.withColumn("good", F.lit(1)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text") \
        .join(F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted, "doc_id", "left").select("doc_id", "text", "good")


def count_ngrams(marked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bucket counts over the trusted documents and over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in row_slices(batches):
            data, offsets = text_buffers(part.column("text"))
            bucket, row = ngram_buckets(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            flag = part.column("good").is_valid().to_numpy(zero_copy_only=False)
            good += np.bincount(bucket[flag[row]], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(good), pa.array(raw)], names=["bucket", "good", "every"])

    rows = marked.select("text", "good").mapInArrow(run, "bucket long, good long, every long").groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every")).collect()
    good, every = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        good[r.bucket], every[r.bucket] = r.good, r.every
    return good, every


def log_ratios(good: np.ndarray, every: np.ndarray, smooth: float = 1.0):
    """A function of buckets, and of what to take off their target counts and the target's total, that gives
    log probability in the target minus that in the raw corpus, smoothed towards the raw."""
    raw = (every + smooth) / (every.sum() + smooth * BUCKETS)
    weight = 0.1 * BUCKETS * smooth
    prior, total = weight * raw, good.sum() + weight

    def ratios(bucket, less=0, less_total=0):
        return np.log((good[bucket] - less + prior[bucket]) / (total - less_total)) - np.log(raw[bucket])

    return ratios


def ngram_scores(bucket: np.ndarray, row: np.ndarray, own: np.ndarray, ratios) -> np.ndarray:
    """Mean ratio of each row's n-grams. A row that is ``own`` (counted in the target) is scored without its own counts,
    as a document of the same words that nobody labelled would be."""
    cell, number = np.unique(row * BUCKETS + bucket, return_counts=True)
    at, bucket = np.divmod(cell, BUCKETS)
    size = np.bincount(row, minlength=len(own))
    mine = own[at]
    value = number * ratios(bucket, np.where(mine, number, 0), np.where(mine, size[at], 0))
    return np.bincount(at, value, minlength=len(own)) / np.maximum(1, size)


def _scored(marked: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = log_ratios(*shared.value)
        for part in row_slices(batches):
            data, offsets = text_buffers(part.column("text"))
            base, _, _ = base_counts(data, offsets)
            score = ngram_scores(*ngram_buckets(data, offsets), part.column("good").is_valid().to_numpy(zero_copy_only=False), ratios)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(base[c]) for c in _BASE], pa.array(score)],
                                             names=["doc_id", *_BASE, "score"])

    return marked.mapInArrow(run, "doc_id long, " + "".join(f"{c} long, " for c in _BASE) + "score double") \
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """The score that separates good from bad labelled documents best; those failing the base rules don't count.

    Without both kinds nothing is told apart and every score passes.
    """
    cell = F.least(F.greatest(F.floor((F.col("score") + SPAN) * BINS / (2 * SPAN)), F.lit(0)), F.lit(BINS - 1))
    rows = (scores.where("not base_failed").join(labels, "doc_id").groupBy(cell.alias("cell"))
            .agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect())
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in rows:
        good[r.cell], bad[r.cell] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return -SPAN
    # Cut below cell i: bad ones below it are right, good ones below it are wrong.
    gain = np.concatenate([[0], np.cumsum(bad / bad.sum() - good / good.sum())])[:BINS]
    best = np.flatnonzero(gain >= gain.max() - 1e-9)
    run = best[:np.flatnonzero(np.append(np.diff(best), 2) > 1)[0] + 1]
    return float(-SPAN + 2 * SPAN * run.mean() / BINS)  # the middle of the gap


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, score and kept of every document.

    Null and word-less texts have zero counts, score 0 and fail the base
    rules. The target is counted over all documents labelled good, the raw
    corpus and the threshold's histograms over everything. A document that is
    in the target is scored against the rest of it, so labelled and unlabelled
    documents are measured alike, and the threshold is set on such scores.
    Repeated rows are treated alike, other columns ignored.
    """
    known = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.min("quality").cast("int").alias("quality")))
    trusted = known.where("quality = 1").select("doc_id")
    marked = mark_trusted(docs, trusted)
    shared = docs.sparkSession.sparkContext.broadcast(count_ngrams(marked))
    scores = materialise(_scored(marked, shared))
    shared.destroy()
    cut = threshold(scores, known)
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= cut))


