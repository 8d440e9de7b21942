"""Approximate nearest neighbours: inverted lists scanned dimension by dimension.

Vectors are scaled to length 1 (the largest cosine is the smallest distance)
and assigned to the nearest of about sqrt(n) centroids. A query probes its
nearest lists. Within a list the vectors, rotated by a fixed random rotation,
are read in blocks of columns; after each block a hypothesis test on the
partial distances abandons the candidates that are, with high confidence,
farther than the list's k-th best so far (after d of D dimensions: partial
distance * D / d > best * (1 + epsilon / sqrt(d))^2). What is left is measured
in double precision on the original vectors.

How many lists to probe is measured, not guessed: ``calibrate`` vectors are
searched exhaustively, and the smallest number of lists that finds
``target_recall`` of their true neighbours is taken for all.

Lists are cut into parts of about ``part_rows`` vectors and the queries of a
part into parts of about ``part_queries``, so a list that holds a third of all
rows becomes many small tasks. Centroids (about sqrt(n) of them), list sizes
and the calibration vectors are all that the driver and each task hold whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise

BLOCK, EPSILON, WARM = 16, 2.1, 32


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(7).standard_normal((dims, dims)))[0]


def _matrix(column, dims: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), dims)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same vectors give the same value in any batch.

    Rows are scaled by a power of two first, which changes no digit and keeps huge and tiny ones in range.
    """
    a, b = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]) for v in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def fit_centroids(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(steps):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-9, total / np.maximum(size, 1e-9), c)
    return c


def scan(cand: np.ndarray, query: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, query) pairs of rotated unit rows that the tests leave, the ``keep`` nearest of each query among them."""
    m, dims = cand.shape
    far = lambda c: 2 - 2 * (c @ query.T)
    warm = far(cand[:WARM])
    best = np.partition(warm, min(keep, len(warm)) - 1, axis=0)[min(keep, len(warm)) - 1] if m > keep else np.full(len(query), np.inf)
    best = best + 1e-6
    first = [np.nonzero(warm <= best)]
    for a in range(WARM, m, 1024):  # the threshold tightens from part to part
        part = cand[a:a + 1024]
        d = min(BLOCK, dims)
        sums = (part[:, :d] ** 2).sum(axis=1)[:, None] + (query[:, :d] ** 2).sum(axis=1)[None, :] - 2 * part[:, :d] @ query[:, :d].T
        c, q = np.nonzero(sums * (dims / d) <= best * (1 + EPSILON * (d < dims) / np.sqrt(d)) ** 2)
        sums = sums[c, q]
        while d < dims:
            e = min(d + BLOCK, dims)
            sums = sums + ((part[c, d:e] - query[q, d:e]) ** 2).sum(axis=1)
            d = e
            near = sums * (dims / d) <= best[q] * (1 + EPSILON * (d < dims) / np.sqrt(d)) ** 2
            c, q, sums = c[near], q[near], sums[near]
        first.append((c + a, q))
        order = np.lexsort((sums, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        last = order[rank == keep - 1]
        best[q[last]] = np.minimum(best[q[last]], sums[last] + 1e-6)
    return np.concatenate([f[0] for f in first]), np.concatenate([f[1] for f in first])


def _top(query_id: np.ndarray, vec_id: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Positions of each query's best, ties to the smaller vec_id."""
    order = np.lexsort((vec_id, -score, query_id))
    q = query_id[order]
    return order[np.arange(len(q)) - np.searchsorted(q, q) < keep]


def neighbours(vectors: DataFrame, every: int = 50, keep: int = 5, target_recall: float = 0.96, max_train: int = 20000,
               calibrate: int = 128, part_rows: int = 4096, part_queries: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the ``keep`` nearest rows of each row whose vec_id is divisible by ``every``.

    Rows with a null id or vector, a null or non-finite component, length
    zero, or another number of components than most rows take no part. Rows
    that repeat a vec_id are one vector (the smallest). Other columns are
    ignored. Empty in, empty out.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
        "and exists(v, x -> x <> 0)")
    shape = usable.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], out)
    dims = shape["d"]
    usable = usable.where(F.size("v") == dims)
    if not usable.groupBy("vec_id").count().where("count > 1").isEmpty():
        usable = usable.groupBy("vec_id").agg(F.min("v").alias("v"))
    n = usable.count()
    lists = max(1, round(n ** 0.5))
    sample = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(max_train, 8 * lists)).collect()
    model = (fit_centroids(_unit(np.array([r.v for r in sample])), min(lists, len(sample))), rotation(dims))
    shared = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value[0]
        for b in batches:
            if b.num_rows:
                near = (_unit(_matrix(b.column("v"), dims)) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(near, pa.int32())], names=["vec_id", "v", "list"])

    index = materialise(usable.mapInArrow(assign, "vec_id long, v array<double>, list int"))
    sizes = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}
    size = np.array([sizes.get(i, 0) for i in range(len(model[0]))])

    # How far down each calibration vector's order of lists its true neighbours are.
    probe = sample[:calibrate]
    exact = spark.sparkContext.broadcast((np.array([r.vec_id for r in probe]), np.array([r.v for r in probe])))

    def exhaust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, v = exact.value
        for b in batches:
            if not b.num_rows:
                continue
            got, where = b.column("vec_id").to_numpy(), b.column("list").to_numpy()
            s = _unit(v) @ _unit(_matrix(b.column("v"), dims)).T
            s[ids[:, None] == got[None, :]] = -9
            near = np.argsort(-s, axis=1)[:, :keep]
            q = np.repeat(np.arange(len(ids)), near.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(where[near.ravel()]), pa.array(s[q, near.ravel()])], names=["q", "list", "s"])

    truth = (index.mapInArrow(exhaust, "q long, list int, s double").where("s > -2")
             .withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s")))).where(F.col("r") <= keep).collect())
    near = np.argsort(-(_unit(exact.value[1]) @ model[0].T), axis=1)
    depth = np.sort([int(np.flatnonzero(near[r.q] == r["list"])[0]) + 1 for r in truth])
    probes = int(depth[min(len(depth) - 1, int(np.ceil(target_recall * len(depth))) - 1)]) if len(depth) else len(size)

    parts = np.maximum(1, -(-size // part_rows))
    load = np.full(len(size), max(1, -(-n // (every * part_queries))))  # enough parts if all queries probe the list
    layout = spark.sparkContext.broadcast((size, parts, load))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _ = shared.value
        count, cut, block = layout.value
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("vec_id").to_numpy()
            order = np.argsort(-(_unit(_matrix(b.column("v"), dims)) @ centroids.T), axis=1)
            enough = (np.cumsum(count[order], axis=1) > keep).argmax(axis=1) + 1
            if count.sum() <= keep:
                enough[:] = len(count)
            rows = [(i, x, p, abs(int(ids[i]) // every) % block[x]) for i in range(len(ids))
                    for x in order[i, :max(probes, enough[i])] for p in range(cut[x])]
            take = np.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(ids[take]), b.column("v").take(pa.array(take)), *[
                pa.array([int(r[k]) for r in rows], pa.int32()) for k in (1, 2, 3)]], names=["vec_id", "v", "list", "part", "block"])

    key = ["list", "part", "block"]
    asked = index.select("vec_id", "v").where(F.col("vec_id") % every == 0).mapInArrow(visit, "vec_id long, v array<double>, list int, part int, block int")
    layout_rows = spark.createDataFrame([(int(i), int(parts[i]), int(load[i])) for i in range(len(size)) if size[i]], "list int, parts int, blocks int")
    held = (index.join(F.broadcast(layout_rows), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("vec_id", "v", *key))

    def search(_, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        cand, query = _matrix(left["v"], dims), _matrix(right["v"], dims)
        ids, asked_ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        turn = shared.value[1]
        c, q = scan(_unit(cand) @ turn, _unit(query) @ turn, keep + 1)  # one more: the query itself may be here
        other = ids[c] != asked_ids[q]
        c, q = c[other], q[other]
        score = cosines(cand[c], query[q])
        best = _top(asked_ids[q], ids[c], score, keep)
        return pa.table({"query_id": asked_ids[q][best], "vec_id": ids[c][best], "score": score[best]})

    found = held.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
