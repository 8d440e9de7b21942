"""Hierarchical language identification: family first, then pairs of close relatives.

A text's features are the relative frequencies of its hashed byte 1- to
4-grams (A-Z folded, ends of words included). One-versus-rest linear support
vector machines choose the language family; within a family a linear support
vector machine for each pair of its languages votes. All are linear in the
same features, so scoring a text of any length is one lookup and sum per
n-gram and machine.

The machines are fitted on the driver from at most ``per_language`` documents
of each language (those whose ids hash lowest) as vectors of ``DIMS`` numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import row_slices, text_buffers
from .toxicity import held_out

DIMS = 1 << 12
UNKNOWN = "und"

# Language codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi bn mr gu pa ur ne si",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    families: list[str]
    weights: np.ndarray  # DIMS x machines: a family's machines first, then the pairs'
    bias: np.ndarray
    pairs: list[tuple[int, int, int]]  # (family, language, language), by column after the families


def ngram_features(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature of every byte n-gram by length (n-grams across rows included), and valid lengths by position."""
    b = _FOLD[data]
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    out, h = [], np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        h = h[:len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1:] + np.uint32(n)
        x = h ^ (h >> np.uint32(15))
        x = x * np.uint32(0x2C1B3C6D)
        out.append(((x ^ (x >> np.uint32(12))) % np.uint32(DIMS)).astype(np.int32))
    return out, room


def _row_vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Relative n-gram frequencies (rows x DIMS)."""
    rows = len(offsets) - 1
    row = np.repeat(np.arange(rows), np.diff(offsets))
    grams, room = ngram_features(data, offsets)
    out = np.zeros((rows, DIMS))
    for n, g in enumerate(grams, 1):
        ok = np.flatnonzero(room[:len(g)] >= n)
        out += np.bincount(row[ok] * DIMS + g[ok], minlength=rows * DIMS).reshape(rows, DIMS)
    return out / np.maximum(1, out.sum(axis=1, keepdims=True))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        rows = []
        data, offsets = text_buffers(part.column("text"))
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            rows.append(_row_vectors(data[a:b], np.array([0, b - a]))[0].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(rows, pa.binary())], names=["doc_id", "lang", "x"])


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """L2 support vector machine (squared hinge) by accelerated gradient descent; classes weigh alike. y: -1 or 1."""
    n, d = x.shape
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w, z = np.zeros(d + 1), np.zeros(d + 1)
    big = 2 * cost * ((x ** 2).sum(axis=1) + 1).max() + 1
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ z[:-1] + z[-1])) * share * y
        grad = np.append(z[:-1], 0) - 2 * cost * np.append(x.T @ slack, slack.sum())
        new = z - grad / big
        z = new + t / (t + 3) * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, per_language: int = 600) -> LanguageModel | None:
    """Fit on ``docs`` (doc_id, text, lang); rows with a null id, text or language are ignored. None: nothing to learn."""
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    hashed = F.xxhash64("doc_id")
    first = F.row_number().over(W.partitionBy("lang").orderBy(hashed, "doc_id"))
    chosen = known.select("doc_id", "lang", first.alias("r")).where(F.col("r") <= per_language).select("doc_id", "lang")
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())
    if not languages:
        return None
    # The bound: per_language rows of each language.
    rows = sorted(known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])
                  .mapInArrow(_vectors, "doc_id long, lang string, x binary").collect(), key=lambda r: (r.doc_id, r.lang, r.x))
    x = np.stack([np.frombuffer(r.x, np.float32) for r in rows]).astype(np.float64)
    y = np.array([languages.index(r.lang) for r in rows])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-5) * np.sqrt(DIMS)
    x = (x - mean) / scale
    family = [FAMILY_OF.get(c, c) for c in languages]
    families = sorted(set(family))
    of = np.array([families.index(f) for f in family])
    machines = [fit_svm(x, np.where(of[y] == f, 1.0, -1.0)) if len(families) > 1 else (np.zeros(DIMS), 1.0) for f in range(len(families))]
    pairs = [(int(of[i]), i, j) for i, j in combinations(range(len(languages)), 2) if of[i] == of[j]]
    for _, i, j in pairs:
        some = (y == i) | (y == j)
        machines.append(fit_svm(x[some], np.where(y[some] == i, 1.0, -1.0)))
    w = np.stack([m[0] for m in machines], axis=1) / scale[:, None]
    bias = np.array([m[1] for m in machines]) - mean @ w
    return LanguageModel(languages, families, w.astype(np.float32), bias, pairs)


def _decide(m: LanguageModel, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) from the machines' margins (rows x machines)."""
    n, k = len(margin), len(m.families)
    sure = lambda v: 1 / (1 + np.exp(-2 * np.clip(v, -15, 15)))
    family_p = sure(margin[:, :k])
    family_p /= family_p.sum(axis=1, keepdims=True)
    family = margin[:, :k].argmax(axis=1)
    of = [m.families.index(FAMILY_OF.get(c, c)) for c in m.languages]
    votes, belief, rivals = (np.zeros((n, len(m.languages))) for _ in range(3))
    for c, (_, i, j) in enumerate(m.pairs):
        v = margin[:, k + c]
        votes[:, i] += v > 0
        votes[:, j] += v <= 0
        belief[:, i] += sure(v)
        belief[:, j] += 1 - sure(v)
        rivals[:, [i, j]] += 1
    mine = np.array(of)[None, :] == family[:, None]
    best = np.where(mine, votes + belief / 1000, -1).argmax(axis=1)
    at = np.arange(n)
    within = np.where(rivals[at, best] > 0, belief[at, best] / np.maximum(1, rivals[at, best]), 1.0)
    return best, family_p[at, family] * within


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text; ``und`` with score 0 for a null text or one without letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in row_slices(batches, limit=1 << 20):
            data, offsets = text_buffers(part.column("text"))
            n = part.num_rows
            ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
            has = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
            for i in np.flatnonzero(~has):
                has[i] = any(map(str.isalpha, data[offsets[i]:offsets[i + 1]].tobytes().decode("utf-8", "replace")))
            if m is None:
                has[:] = False
            langs, score = [UNKNOWN] * n, np.zeros(n)
            if has.any():
                grams, room = ngram_features(data, offsets)
                margin, count = np.zeros((n, len(m.bias))), np.zeros(n)
                for k, g in enumerate(grams, 1):
                    ok = room[:len(g)] >= k
                    seen = np.concatenate([[0], np.cumsum(ok), np.full(k - 1, ok.sum())])
                    count += seen[offsets[1:]] - seen[offsets[:-1]]
                    for c in range(len(m.bias)):
                        total = np.concatenate([[0], np.cumsum(np.where(ok, m.weights[g, c], 0), dtype=np.float64)])
                        total = np.append(total, np.full(k - 1, total[-1]))
                        margin[:, c] += total[offsets[1:]] - total[offsets[:-1]]
                best, p = _decide(m, margin / np.maximum(1, count)[:, None] + m.bias)
                langs = [m.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
                score = np.where(has, p, 0.0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 3, fold: int = 1, per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; the held-out fold's languages are not learnt.

    Repeated rows are predicted alike, columns other than doc_id, text and
    lang ignored; with no labelled row every text is ``und``.
    """
    out = held_out("doc_id", folds, fold)
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~out), per_language)
    return predict(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")
