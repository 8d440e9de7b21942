"""Hard negatives by exact scores from Kronecker-packed products.

Components become integers floor(256 * x). In a tile of candidates each
component is biased to be non-negative and several candidates' components are
packed into separated fields of one wide integer. Anchors are biased too, so
a product with an anchor's component stays within its field, and so does the
sum over all components, as the fields are that wide. One multiplication an
anchor component thus serves all candidates of a word; the fields of the sums
are unpacked and the biases, known from the rows' sums, taken off:

    sum((a + A) * (c + C)) = sum(a * c) + C * sum(a) + A * sum(c) + d * A * C

Words of up to 53 bits are whole numbers that doubles hold exactly, as are all
products and partial sums, so the multiplications are one matrix product a
tile. Components too large for that go into integers of any width, a tile's
candidates in one. The scores are the same.

All anchors meet all rows in blocks: the rows are dealt into blocks by a hash,
the anchors too, and a task takes one block of each. Block counts depend on
the numbers of rows alone, so neither labels nor equal vectors make a block
large. A first pass finds each anchor's positives, a second one, with their
scores as bounds, the negatives. Each task returns a few rows for each of its
anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise

SCALE = 256
WORD_BITS = 53
TILE_ANCHORS, TILE_ROWS = 256, 2048
LIMIT = 2 ** 63 - 1


def components(v: np.ndarray) -> np.ndarray:
    """floor(256 * x): int64, or Python integers where one is beyond 2**52."""
    with np.errstate(over="ignore"):
        scaled = np.floor(v * SCALE)
    if not v.size or np.abs(scaled).max() < 2.0 ** 52:
        return scaled.astype(np.int64)
    return np.array([SCALE * int(x) if abs(x) >= 2.0 ** 52 else int(np.floor(x * SCALE)) for x in v.ravel()], object).reshape(v.shape)


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors (anchors x rows), exactly."""
    dims = anchors.shape[1]
    if not dims or not len(rows) or not len(anchors):
        return np.zeros((len(anchors), len(rows)), np.int64)
    low_a, low_c = int(anchors.min()), int(rows.min())
    field = max(1, ((int(anchors.max()) - low_a) * (int(rows.max()) - low_c) * dims).bit_length())
    if field > WORD_BITS or dims * max(abs(low_a), int(anchors.max()) - low_a) * max(abs(low_c), int(rows.max()) - low_c) >= 2 ** 60:
        anchors, rows = anchors.astype(object), rows.astype(object)
    a, c = anchors - low_a, rows - low_c  # biased by -low
    sums = _words(a, c, field) if field <= WORD_BITS else _wide(a, c, field)
    at, ct = a.sum(axis=1), c.sum(axis=1)
    return sums + low_c * at[:, None] + low_a * ct[None, :] + dims * low_a * low_c


def _words(a: np.ndarray, c: np.ndarray, field: int) -> np.ndarray:
    """Sums of products with as many candidates a word as 53 bits hold."""
    per = WORD_BITS // field
    n = len(c)
    words = np.zeros((-(-n // per), c.shape[1]), np.int64)
    for k in range(per):
        words[:len(c[k::per])] += c[k::per].astype(np.int64) << (k * field)
    total = (a.astype(np.float64) @ words.T.astype(np.float64)).astype(np.int64)
    out = np.empty((len(a), len(words) * per), np.int64)
    for k in range(per):
        out[:, k::per] = (total >> (k * field)) & ((1 << field) - 1)
    return out[:, :n]


def _wide(a: np.ndarray, c: np.ndarray, field: int) -> np.ndarray:
    """The same with one integer a component for all candidates."""
    size = -(-field // 8)
    words = [int.from_bytes(b"".join([int(x).to_bytes(size, "little") for x in column]), "little") for column in c.T]
    out = np.empty((len(a), len(c)), object)
    for i, row in enumerate(a):
        total = sum(int(x) * w for x, w in zip(row, words, strict=True)).to_bytes(size * len(c), "little")
        out[i] = [int.from_bytes(total[k:k + size], "little") for k in range(0, len(total), size)]
    return out


def _reduce(query: np.ndarray, score: np.ndarray, at: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best of each query, nearer positions first among equals."""
    order = np.lexsort((at, -score, query))
    query, score, at = query[order], score[order], at[order]
    top = np.arange(len(query)) - np.searchsorted(query, query) < keep
    return query[top], score[top], at[top]


def best_between(anchors: np.ndarray, rows: np.ndarray, allowed, low: np.ndarray, high: np.ndarray, keep: int):
    """(anchor, bound, row position, score): for each anchor and each of its bounds the best ``keep`` rows scoring in them.

    ``low`` and ``high``: anchors x bounds, as ``_bounds`` gives them;
    ``allowed(anchor slice, row slice)``: which pairs count. Rows come in the
    order of their ids, which decides between equal scores.
    """
    out = []
    bounds = low.shape[1]
    for i in range(0, len(anchors), TILE_ANCHORS):
        some = slice(i, min(i + TILE_ANCHORS, len(anchors)))
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(bounds)]
        floor, top = low[some].copy(), high[some]
        for j in range(0, len(rows), TILE_ROWS):
            part = slice(j, min(j + TILE_ROWS, len(rows)))
            scores = packed_scores(anchors[some], rows[part])
            may = allowed(some, part)
            if scores.dtype == object:
                floor, top = floor.astype(object), top.astype(object)
            for r in range(bounds):
                # In a later tile an equal score comes after those found.
                q, k = np.nonzero(may & (scores >= floor[:, r, None]) & (scores <= top[:, r, None]))
                if not len(q):
                    continue
                q, s, at = _reduce(np.concatenate([best[r][0], q]), np.concatenate([best[r][1], scores[q, k]]), np.concatenate([best[r][2], k + j]), keep)
                best[r] = (q, s, at)
                first, last = np.searchsorted(q, np.arange(some.stop - i)), np.searchsorted(q, np.arange(some.stop - i), side="right")
                full = np.flatnonzero(last - first == keep)
                floor[full, r] = s[last[full] - 1] + 1
        out += [(q + i, np.full(len(q), r), at, s) for r, (q, s, at) in enumerate(best)]
    if not out:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate([x[k] for x in out]) for k in range(4)]


def _bounds(values: list[list[int]]) -> np.ndarray:
    """int64 if all fit (no product that comes as int64 reaches 2**62), else Python integers."""
    if all(abs(x) <= LIMIT for row in values for x in row):
        return np.array(values, np.int64)
    return np.array([[*row, None] for row in values], object)[:, :-1]


def _vectors(column) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if len(a.flatten()) else 0)


def _text(scores) -> pa.Array:
    """Scores as decimal text, so that those beyond 64 bits stay exact between the passes."""
    return pa.array([str(int(s)) for s in scores], pa.string())


def _ordered(score: str) -> list[Column]:
    """Descending order of whole numbers written in decimal."""
    minus, digits = F.col(score).startswith("-"), F.length(score)
    return [minus.asc(), F.when(minus, -digits).otherwise(digits).desc(), F.when(minus, F.col(score)).asc(), F.when(~minus, F.col(score)).desc()]


def _long(score: str) -> Column:
    """As a long, the nearest one where it is beyond 64 bits."""
    at_most = F.when(F.col(score).startswith("-"), F.lit(-LIMIT - 1)).otherwise(F.lit(LIMIT))
    return F.coalesce(F.expr(f"try_cast({score} as bigint)"), at_most)


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, floor_pct: int = 80,
                   block_rows: int = 32_768, block_anchors: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Takes vec_id, embedding and label. Anchors are the rows whose vec_id is
    divisible by ``every``; positives the best others of the anchor's label;
    negatives the best rows of other labels that reach ``floor_pct`` per cent
    of the positive's score and don't exceed it. Equal scores: the smaller
    vec_id first. Rows with a null label, id or vector, or a null or
    non-finite component take no part. Vectors of different lengths have no
    inner product and don't meet. Rows that repeat a vec_id are rows each, also
    as anchors; of rows alike in id and score it does not matter which stands
    first. Scores beyond 64 bits are compared exactly and returned as the
    nearest long. Other columns are ignored. Empty in, empty out.
    """
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("long").alias("label")) \
        .where("vec_id is not null and v is not null and label is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = materialise(usable.select(F.monotonically_increasing_id().alias("row"), "*", F.size("v").alias("d")))
    n = rows.count()
    # Columns of their own for the anchors, as both sides of a cogroup come from one table.
    anchors = rows.where(F.col("vec_id") % every == 0).select(*[F.col(c).alias(c) for c in rows.columns])
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks, shares = max(1, -(-n // block_rows), min(parts, n // TILE_ROWS)), max(1, -(-anchors.count() // block_anchors))
    key = ["d", "block", "share"]
    # Blocks by a hash of the row: equal ids, labels and vectors spread evenly.
    block, share = (F.pmod(F.xxhash64("row", F.lit(k)), F.lit(m)).cast("int") for k, m in ((1, blocks), (2, shares)))
    spread = lambda df, c, m: df.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    held = spread(rows.withColumn("block", block), "share", shares)
    asked = spread(anchors.withColumn("share", share), "block", blocks)

    def sides(left: pa.Table, right: pa.Table):
        left = left.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        cand, query = components(_vectors(left["v"])), components(_vectors(right["v"]))
        names = lambda t: (t["row"].to_numpy(), t["vec_id"].to_numpy(), t["label"].to_numpy())
        return cand, query, names(left), names(right)

    def positive(_, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("positive_id", pa.int64()), ("score", pa.string())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        cand, query, (row, ids, label), (asked_row, _, asked_label) = sides(left, right)
        most = int(np.abs(query).max(initial=0)) * int(np.abs(cand).max(initial=0)) * query.shape[1]  # no score is beyond
        low, high = _bounds([[-most]] * len(query)), _bounds([[most]] * len(query))
        a, _, c, s = best_between(query, cand, lambda i, j: (asked_label[i, None] == label[None, j]) & (asked_row[i, None] != row[None, j]), low, high, positives)
        return pa.table([asked_row[a], ids[c], _text(s)], schema=schema)

    near = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(positive, "row long, positive_id long, score string")
    rank = F.row_number().over(W.partitionBy("row").orderBy(*_ordered("score"), "positive_id"))
    found = materialise(near.withColumn("place", rank).where(F.col("place") <= positives))
    scores = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # at most ``positives`` each
    asked2 = spread(anchors.join(scores.select("row", F.col("p.score").alias("bounds")), "row").withColumn("share", share), "block", blocks)

    def negative(_, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative", pa.string())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        cand, query, (_, ids, label), (asked_row, _, asked_label) = sides(left, right)
        high = [[int(x) for x in p] for p in right["bounds"].to_pylist()]
        low = [[-(-floor_pct * x // 100) for x in p] for p in high]
        # Fewer positives than asked for: an empty range for the rest.
        low, high = (_bounds([p + [end] * (positives - len(p)) for p in side]) for side, end in ((low, 1), (high, 0)))
        a, r, c, s = best_between(query, cand, lambda i, j: asked_label[i, None] != label[None, j], low, high, negatives)
        return pa.table([asked_row[a], (r + 1).astype(np.int32), ids[c], _text(s)], schema=schema)

    hard = held.groupBy(*key).cogroup(asked2.groupBy(*key)).applyInArrow(negative, "row long, place int, negative_id long, negative string")
    rank = F.row_number().over(W.partitionBy("row", "place").orderBy(*_ordered("negative"), "negative_id"))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    names = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return hard.join(found, ["row", "place"]).join(names, "row").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", _long("score").alias("positive_score"), _long("negative").alias("negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The table with the label of every seventh id moved on by one, modulo 10."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
