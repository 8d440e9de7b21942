"""Sharding by longest-processing-time scheduling.

Documents of equal text are a group and stay together. The groups are ordered
by bytes, largest first, and each goes to the least-loaded shard, found
through a heap. A heap works through its items one by one, so what enters it
must not grow with the corpus: groups smaller than a share of what is left are
bundled with their neighbours in the order. With ``rest`` the bytes from a
group to the end of the line, the line is cut at every 1 / (2 * 64 * shards)
of the power-of-two fraction of the total that ``rest`` falls in. A group at
least that large is an item by itself; and with fewer than 64 * shards groups
every group is, as the largest of the rest cannot be below its average. The
bundles shrink with the rest, down to 2 ** -``LEVELS`` of the total, so the
last items level the shards nearly to the byte. There are at most
64 * shards + 1 items a level, and two bundles more where a level ends.

The sizes are summed up and ordered on rows without texts. Groups that hold
more than 1 / ``HEAVY`` of all rows (fewer than ``HEAVY``) meet their rows by a
broadcast, all others in a join, so a text that a third of all rows share is
no hot key. Numbers inside the shards come from a range sort and the counts
of its partitions.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise

LEVELS, FINE, HEAVY = 24, 64, 10_000
ROW_BYTES = 8


def schedule(items: list[tuple[int, int]], shards: int) -> list[int]:
    """Shard of each (bytes, order): the largest first (the smaller order among equals), onto the least-loaded (the lowest among equals)."""
    heap, out = [(0, s) for s in range(shards)], [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1])):
        load, s = heap[0]
        out[i] = s
        heapq.heapreplace(heap, (load + items[i][0], s))
    return out


def running(df: DataFrame, order: list, value: str, spark) -> DataFrame:
    """``df`` range-sorted by ``order`` with the column ``before``: the sum of ``value`` over all rows ahead, found from one row per partition."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            x = b.column(value).to_numpy()
            ahead = at + np.cumsum(x) - x
            at += int(x.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(x), part), pa.int32()), pa.array(ahead, pa.int64())], names=[*names, "part", "ahead"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    line = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(place, f"{kinds}, part int, ahead long"))
    first = line.groupBy("part").agg(F.sum(value).alias("n"))
    first = first.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("start"))  # a row per partition
    return line.join(F.broadcast(first), "part").select(*names, (F.col("ahead") + F.col("start")).alias("before"))


def _items(groups: DataFrame, total: int, shards: int) -> DataFrame:
    """``groups`` in their order with the item that each belongs to."""
    spark = groups.sparkSession
    line = running(groups, [F.desc("bytes"), F.asc_nulls_first("first_id"), "crc", "hash"], "bytes", spark)
    rest = F.lit(total) - F.col("before")
    level = F.least(F.floor(F.log2(F.lit(float(total)) / rest)), F.lit(LEVELS - 1)).cast("long")
    unit = F.greatest(F.lit(1), F.floor(F.lit(total) / F.pow(F.lit(2.0), level) / (2 * FINE * shards))).cast("long")
    return line.withColumns({"level": level, "cut": F.floor(rest / unit).cast("long")})


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot.

    ``size``: UTF-8 bytes of the text and 8 more. A null text has no bytes and
    is of one group with the empty texts. Rows that repeat a doc_id, or whole
    rows, are documents each. Slots count a shard's documents from 0 by doc_id
    (null first), then size and checksum. Other columns are ignored. Empty in,
    empty out; shards without a group stay empty.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
                                   F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("hash")))
    key = ["hash", "crc", "size"]
    groups = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")) \
        .select(*key, "n", "first_id", (F.col("n") * F.col("size")).alias("bytes"))
    groups = materialise(groups)
    total, count = groups.agg(F.sum("bytes"), F.sum("n")).first()
    line = materialise(_items(groups, total or 0, shards)) if total else groups.withColumns({"before": F.lit(0), "level": F.lit(0), "cut": F.lit(0)})
    items = line.groupBy("level", "cut").agg(F.sum("bytes").alias("bytes"), F.min("before").alias("before")).orderBy("before").collect()
    where = schedule([(r.bytes, r.before) for r in items], shards)
    plan = spark.createDataFrame([(r.level, r["cut"], s) for r, s in zip(items, where, strict=True)], "level long, cut long, shard int")
    placed = materialise(line.join(F.broadcast(plan), ["level", "cut"]).select(*key, "n", "shard"))

    many = F.col("n") * HEAVY > (count or 0)
    wide = rows.join(F.broadcast(placed.where(many).select(*key, F.col("shard").alias("known"))), key, "left")
    rare = wide.where("known is null").drop("known").join(placed.where(~many).select(*key, "shard"), key)
    found = materialise(wide.where("known is not null").withColumnRenamed("known", "shard").unionByName(rare)
                        .select("doc_id", "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.lit(1).cast("long").alias("one")))
    # Numbers along (shard, doc_id) over all shards, less those of the shards before.
    order = ["shard", F.asc_nulls_first("doc_id"), "size", "text_crc32"]
    numbered = running(found, order, "one", spark)
    start = placed.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("start"))
    return numbered.join(F.broadcast(start), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("before") - F.col("start")).alias("slot"))
