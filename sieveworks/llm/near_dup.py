"""MinHash near-duplicate removal with odd-sketch verification of banded candidates.

1. One pass over the texts (mapInArrow) turns each into its distinct 5-word
   shingle hashes, 256 MinHash samples, 32 bands of 4 samples, and an odd
   sketch: the samples folded into a 1024-bit parity bitmap. The XOR population
   count of two bitmaps estimates how many samples differ.
2. Documents with equal shingle sets form a class by fingerprint; only its
   smallest doc_id goes on, so n copies cost n rows.
3. Band buckets give candidates in two steps that never list a group's pairs.
   First every member against the bucket's leader, the member that meets most
   others over all its bands (the original of near copies). Then, after
   connected components over the confirmed links, the members of buckets that
   still hold several components: pairs of different components meet inside
   a join that compares parity bitmaps of their whole sets, a bound that loses
   none and lets few dissimilar pairs become rows.
4. Pairs that the bitmaps allow are confirmed on their full shingle sets
   (100 * intersection >= threshold_pct * union).

A link is missed only if no band agrees (0.5e-5 at similarity 0.75, less
above) or its bitmaps differ by over ``MAX_XOR`` bits (below 1e-7 there).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .kernels import WORD_LOWER, grams, mix64, row_slices, seeded, text_buffers, word_hashes
from .scratch import materialise

SAMPLES, BANDS, BAND_ROWS, SKETCH_BITS, PARITY_BITS = 256, 32, 4, 1024, 2048
SHINGLE = 5
#: At similarity 0.75 on average 64 of 256 samples differ (deviation 6.9), so 113 of 1024 bits do
#: (deviation 12.4 with the collisions of toggles). 5.3 deviations more: probability 1e-7.
MAX_XOR = 179

_A = (seeded(21, SAMPLES) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (seeded(22, SAMPLES) >> np.uint64(32)).astype(np.uint32)

#: Members of a bucket that meet in one task.
BLOCK_ROWS = 2_000

#: 16 MB of ids; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000

SIGNATURE_SCHEMA = "doc_id long, n_shingles long, fp_a long, fp_b long, bands array<long>, sketch array<long>"
SET_SCHEMA = "doc_id long, shingles array<long>, parity array<long>"


def shingle_sets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row's whole text."""
    data, offsets = text_buffers(batch.column(batch.schema.get_field_index("text")))
    words, _, rows = word_hashes(data, offsets, WORD_LOWER)
    runs = grams(words, SHINGLE, 5)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(runs[a:b - SHINGLE + 1])
        elif b > a:  # the whole sequence is the one shingle
            yield grams(words[a:b], int(b - a), 50 + int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    a = mix64(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s))]))
    b = np.bitwise_xor.reduce(mix64(s + np.uint64(77))) if len(s) else np.uint64(0)
    return int(a.view(np.int64)[0]), int(np.array([b]).view(np.int64)[0])


def minhash(s: np.ndarray) -> np.ndarray:
    """256 minima of multilinear 32-bit hashes."""
    best = np.full(SAMPLES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(s), 4096):
        part = s[i:i + 4096]
        lo, hi = part.astype(np.uint32), (part >> np.uint64(32)).astype(np.uint32)
        best = np.minimum(best, (_A[:, None] * lo[None, :] + _B[:, None] * hi[None, :]).min(axis=1))
    return best


def parity(cell: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """Bitmaps (rows x bits / 64, int64) of the cells toggled an odd number of times."""
    odd = (np.bincount(cell, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the sets {(position, sample)}, a row each."""
    n = len(samples)
    spot = mix64(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    return parity((spot.astype(np.int64) + np.arange(n)[:, None] * SKETCH_BITS).ravel(), n, SKETCH_BITS)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        sets = list(shingle_sets(part))
        n = len(sets)
        samples = np.stack([minhash(s) for s in sets])
        rows = samples[:, :BANDS * BAND_ROWS].astype(np.uint64).reshape(n, BANDS, BAND_ROWS)
        band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (n, BANDS))
        for i in range(BAND_ROWS):
            band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
        prints = [fingerprint(s) for s in sets]
        yield pa.RecordBatch.from_arrays([
            part.column(part.schema.get_field_index("doc_id")),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([p[0] for p in prints], pa.int64()),
            pa.array([p[1] for p in prints], pa.int64()),
            pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(band.view(np.int64).ravel())),
            pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * (SKETCH_BITS // 64), pa.array(odd_sketches(samples).ravel())),
        ], names=["doc_id", "n_shingles", "fp_a", "fp_b", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        sets = list(shingle_sets(part))
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        flat = np.concatenate(sets)
        cell = (flat % np.uint64(PARITY_BITS)).astype(np.int64) + np.repeat(np.arange(len(sets)), np.diff(ends)) * PARITY_BITS
        words = PARITY_BITS // 64
        yield pa.RecordBatch.from_arrays([
            part.column(part.schema.get_field_index("doc_id")),
            pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64))),
            pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * words, pa.array(parity(cell, len(sets), PARITY_BITS).ravel())),
        ], names=["doc_id", "shingles", "parity"])


def _with_print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in row_slices(batches):
        prints = pa.array([fingerprint(s)[0] for s in shingle_sets(part)], pa.int64())
        yield pa.RecordBatch.from_arrays([*part.columns, prints], names=[*part.schema.names, "fp_a"])


def _can_link(threshold_pct: int, na: str, nb: str, sa: str, sb: str) -> Column:
    """Sizes allow the similarity, and the parity bitmaps do."""
    xor = " + ".join(f"bit_count({sa}[{i}] ^ {sb}[{i}])" for i in range(SKETCH_BITS // 64))
    return F.expr(f"100 * least({na}, {nb}) >= {threshold_pct} * greatest({na}, {nb}) and {xor} <= {MAX_XOR}")


def _by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with distinct ids; up to BROADCAST_IDS of them (counted) are broadcast, so texts stay where they are."""
    ids = materialise(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def _set_table(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles, parity) of the documents named in ``ids``."""
    return materialise(_by_id(texts, ids, "left_semi").select("doc_id", "text").mapInArrow(_sets, SET_SCHEMA))


def _confirm(pairs: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are links on their full shingle sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b").withColumn("common", common)
            .where(100 * F.col("common") >= threshold_pct * (F.col("na") + F.col("nb") - F.col("common")))
            .select("a", "b"))


def _cross_pairs(bucket: DataFrame, sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (a, b, na, nb) of different components in one bucket that the parity of their whole sets allows.

    Two sets differ in at least as many shingles as their parity bitmaps do in
    bits, so no similar pair is lost here, and a dissimilar one is refused
    inside the join. The members of a bucket's largest component are met by
    the others alone, so one stray among n copies costs n comparisons; both
    sides are split into salted blocks of about ``BLOCK_ROWS``, so a bucket
    that holds a third of all rows is many tasks' work.
    """
    held = bucket.groupBy("band", "component").agg(F.count("*").alias("n"))
    main = held.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")) \
        .select("band", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK_ROWS).cast("int").alias("few"),
                F.ceil(F.col("all") / BLOCK_ROWS).cast("int").alias("many"))
    rows = materialise(bucket.join(sets.select("doc_id", F.size("shingles").alias("n"), "parity"), "doc_id").join(main, "band"))
    salt = lambda k, blocks: F.pmod(F.xxhash64("doc_id", F.lit(k)), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    x = rows.where("component <> main").select("band", salt(1, "few").alias("i"), each("many").alias("j"), F.col("component").alias("ca"),
                                               F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    y = rows.select("band", each("few").alias("i"), salt(2, "many").alias("j"), F.col("component").alias("cb"), "main",
                    F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    xor = " + ".join(f"bit_count(pa[{i}] ^ pb[{i}])" for i in range(PARITY_BITS // 64))
    close = F.expr(f"(cb = main or ca < cb) and 100 * least(na, nb) >= {threshold_pct} * greatest(na, nb) and "
                   f"{100 + threshold_pct} * ({xor}) <= {100 - threshold_pct} * (na + nb)")
    return x.join(y, ["band", "i", "j"]).where(close).select("a", "b", "na", "nb").distinct()


def near_duplicates(docs: DataFrame, threshold_pct: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null or word-less texts have an empty set and are linked with nothing.
    Rows that repeat a doc_id are one document; if their texts differ, the one
    with the smallest fingerprint stands for the id. A null doc_id stays
    alone: component_id null, kept true. Other columns are ignored. An empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = materialise(texts.mapInArrow(_signatures, SIGNATURE_SCHEMA))
    sig = every.where("doc_id is not null")
    repeated = sig.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("fp_a").alias("fp_a")).where("n > 1")
    if not repeated.isEmpty():
        again = sig.join(repeated.select("doc_id", F.col("fp_a").alias("stands")), "doc_id", "left")
        sig = materialise(again.where("stands is null or stands = fp_a").drop("stands")
                          .dropDuplicates(["doc_id"]))
        texts = materialise(sig.select("doc_id", F.col("fp_a").alias("of")).join(
            texts.mapInArrow(_with_print, "doc_id long, text string, fp_a long"), "doc_id")
            .where("of = fp_a").select("doc_id", "text").dropDuplicates(["doc_id"]))
    key = ["fp_a", "fp_b", "n_shingles"]
    full = sig.where("n_shingles > 0")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    member = materialise(full.select("doc_id", *key).join(classes, key).select("doc_id", "n_shingles", "rep"))
    first = member.where("doc_id = rep").select("doc_id")
    reps = materialise(full.join(first, "doc_id", "left_semi").select("doc_id", "n_shingles", "bands", "sketch"))

    bands = reps.select(F.explode("bands").alias("band"), "doc_id")
    shared = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    bucket = materialise(bands.join(shared, "band").select("band", "doc_id", "size"))
    degree = bucket.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    lead = (bucket.join(degree, "doc_id").groupBy("band").agg(F.max(F.struct("degree", "doc_id")).alias("top"))
            .select("band", F.col("top.doc_id").alias("leader")))
    bucket = materialise(bucket.join(lead, "band").where("doc_id <> leader"))
    body = reps.select("doc_id", "n_shingles", "sketch")
    may = _can_link(threshold_pct, "na", "nb", "sa", "sb")

    def promising(pairs: DataFrame) -> DataFrame:
        side = lambda x: body.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        return materialise(pairs.join(side("b"), "b").join(side("a"), "a").where(may).select("a", "b", "na", "nb"))

    star = promising(bucket.select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct())
    sets = _set_table(texts, star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct())
    links = materialise(_confirm(star, sets, threshold_pct))
    label = connected_components(links)

    rest = bucket.where("size > 2").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left") \
        .select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = rest.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    rest = materialise(rest.join(mixed.select("band"), "band", "left_semi"))
    sets = _set_table(texts, rest.select("doc_id").distinct())
    cross = materialise(_cross_pairs(rest, sets, threshold_pct))
    # The second pass only has to join components of the first.
    far = materialise(_confirm(cross, sets, threshold_pct))
    if not far.isEmpty():
        at = lambda x: F.coalesce(f"c{x}", x).alias(x)
        known = lambda x: label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        joined = connected_components(far.join(known("a"), "a", "left").join(known("b"), "b", "left").select(at("a"), at("b")))
        every_node = label.unionByName(far.select(F.col("a").alias("node")).union(far.select("b")).distinct()
                                       .join(label, "node", "left_anti").withColumn("component", F.col("node")))
        label = materialise(every_node.join(joined.toDF("component", "to"), "component", "left")
                            .select("node", F.coalesce("to", "component").alias("component")))

    found = member.join(label.withColumnRenamed("node", "rep"), "rep", "left") \
        .select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    sizes = every.select("doc_id", "n_shingles")
    return (sizes.join(found, "doc_id", "left")
            .withColumn("component_id", F.coalesce("component_id", "doc_id"))
            .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", "kept"))


def keep_one(docs: DataFrame, threshold_pct: int = 75) -> DataFrame:
    """``docs``, all columns, without the documents that a smaller doc_id of their component stands for.

    Rows that repeat a kept doc_id leave one row; rows without a doc_id stay.
    """
    found = materialise(near_duplicates(docs, threshold_pct).where("doc_id is not null").select("doc_id", "kept"))
    rest = _by_id(docs, found.where("not kept").select("doc_id").distinct(), "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rest.select(docs.columns)
    return rest.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rest.where("doc_id is null")).select(docs.columns)
