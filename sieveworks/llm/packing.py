"""Packing of tokenised documents along a space-filling curve.

Each document becomes token ids plus an end id. The ids, hashed to a vector
by fixed random directions and averaged, give a point in ``DIMS`` dimensions;
the Hilbert key of that point orders the corpus so that neighbours are alike.
The documents are range-sorted by (key, doc_id), their ids laid end to end
along the curve, and the line cut every ``length`` tokens. Only the last
sequence can be short, so padding is below one sequence in all.

The ids are kept as 16-bit little-endian bytes between the steps. Equal keys
do not pile up, because doc_id takes part in the ranges.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .kernels import row_slices, seeded
from .scratch import materialise

DIMS, BITS = 4, 15
END_ID = 1


@lru_cache(maxsize=1)
def _encoding(vocabulary: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    """The vocabulary's ranks and added tokens in tiktoken: the ids of the same file in tokenizers' format, about four times as fast."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


@lru_cache(maxsize=1)
def _directions(size: int) -> np.ndarray:
    """About normal fixed coordinates of each token (size x DIMS)."""
    bits = seeded(31, size * DIMS * 4).reshape(size, DIMS, 4)
    return ((bits >> np.uint64(40)).astype(np.float64) / 2 ** 24 - 0.5).sum(axis=2)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows x dims, each below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections from the coarsest level down
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):  # Gray code
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):  # interleave
        for i in range(dims):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_cells(ids: list[np.ndarray], size: int) -> np.ndarray:
    """Grid cells of the documents' mean hashed vectors; no coordinate of a direction, so none of a mean, is beyond 2."""
    table = _directions(size)
    points = np.zeros((len(ids), DIMS))
    for i, x in enumerate(ids):
        if len(x):
            points[i] = table[x].mean(axis=0)
    return np.clip((points / 4 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def tokens(docs: DataFrame, vocabulary: str, pattern: str, specials: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(row, doc_id, curve, body, n, ids) of each row's whole text, the end id included; a null text is empty.

    ``specials``: (text, id) of the added tokens, each found wherever a text has it literally.
    ``row`` numbers the rows by task; it holds once the result is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, row = _encoding(vocabulary, pattern, specials), TaskContext.get().partitionId() << 40
        for part in row_slices(batches):
            texts = part.column("text").to_pylist()
            ids = [np.array(enc.encode(t, allowed_special="all"), np.uint16) if t else np.zeros(0, np.uint16) for t in texts]
            blobs = [np.append(x, np.uint16(END_ID)).astype("<u2").tobytes() for x in ids]
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(row - part.num_rows, row)), part.column("doc_id"), pa.array(hilbert_key(curve_cells(ids, enc.n_vocab))),
                pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array([len(b) // 2 for b in blobs], pa.int64()),
                pa.array(blobs, pa.binary()),
            ], names=["row", "doc_id", "curve", "body", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, curve long, body long, n long, ids binary")


def _token_slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows holding about ``limit`` tokens (column n)."""
    for b in batches:
        ends = np.concatenate([[0], np.cumsum(b.column("n").to_numpy())])
        a = 0
        while a < b.num_rows:
            c = max(a + 1, int(np.searchsorted(ends, ends[a] + limit, side="right")) - 1)
            yield b.slice(a, c - a)
            a = c


def pack(docs: DataFrame, vocabulary: str, pattern: str, length: int = 2048, specials: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (array<int>).

    Texts hold no added tokens but those of ``specials``, as in ``tokens``. A
    null or empty text is one end id. A null doc_id sorts first and is kept.
    Repeated rows are packed each; other columns are ignored. Empty in, empty
    out.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    coded = materialise(tokens(docs, vocabulary, pattern, specials))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column("n").to_numpy()
            first = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.full(len(n), part), pa.int32()), pa.array(first, pa.int64()), b.column("n")],
                                             names=["row", "part", "first", "n"])

    # The order is found on narrow rows; the ids move once, to meet their places.
    order = ["curve", "doc_id", "body", "row"]
    line = materialise(coded.select(*order, "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
                       .mapInArrow(place, "row long, part int, first long, n long"))
    # One row per partition: how many tokens lie before it.
    before = line.groupBy("part").agg(F.sum("n").alias("n"))
    before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    places = line.join(F.broadcast(before), "part").select("row", (F.col("first") + F.col("before")).alias("at"))
    placed = coded.select("row", "doc_id", "n", "ids").join(places, "row").select("doc_id", "at", "n", "ids")

    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _token_slices(batches):
            rows, pieces = [], []
            for doc, at, n, blob in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                ids = np.frombuffer(blob, "<u2").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, length - (at + start) % length)
                    piece = ids[start:start + size]
                    rows.append((doc, start, size, zlib.crc32(piece.tobytes()), n, (at + start) // length, (at + start) % length))
                    start += size
                pieces.append(ids)
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)]
            ends = np.concatenate([[0], np.cumsum([r[2] for r in rows])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(pieces).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, schema)
