"""Removal of repeated line runs, with DataFrame functions only.

A line is deleted if it lies in a run of consecutive lines that holds at least
``min_words`` words and also occurs at an earlier place (smaller doc_id, or
earlier in the same document). The first copy of a run stays.

Method: a document is a sequence of line ids. Prefix doubling names the runs of
1, 2, 4, ... lines that begin at each position: a name of 2^k lines is made
from the two names of 2^(k-1) lines it consists of. Two suffixes have a common
prefix of at least m lines exactly if the names of the first and of the last
2^floor(log2 m) lines of these m are equal, so a group by those two names is
the interval of suffixes whose longest common prefix reaches m. A suffix whose
first line occurs once shares no prefix with another; those positions go
before any run is named.

Which m to look at follows from the threshold: each line of a repeated run of
``min_words`` or more words lies in a shortest such run that begins or ends at
some line, so the shortest runs from and to every position decide all.

Names are 128-bit hashes, equal for equal runs; the order of unequal suffixes
is never needed, so no total sort of the corpus is made. A document's line
ids, not its text, pass through the shuffles; only the final join moves texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import materialise

#: Two independent 64-bit hashes of the same values.
SALT = 7


def _name(*cols) -> list[Column]:
    return [F.xxhash64(*cols), F.xxhash64(F.lit(SALT), *cols)]


def _document_key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Rows with the same id and text are one document; a null id comes first."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(text_col).alias("_body")]


def repeated_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _body, gone: disjoint spans (a, b) of line numbers from 0) of documents that lose lines."""
    line = F.transform(F.split(text_col, "\n"), lambda s: F.struct(
        *[c.alias(n) for n, c in zip("xy", _name(s), strict=True)],
        F.size(F.filter(F.split(s, "[ \\t-\\r]+"), lambda w: w != "")).alias("w")))
    lines = (docs.where(F.col(text_col).isNotNull())
             .select(*_document_key(docs, id_col, text_col), line.alias("lines"))
             .groupBy("_doc", "_body").agg(F.first("lines").alias("lines"))
             .select("_doc", "_body", F.posexplode("lines").alias("at", "line")).select("_doc", "_body", "at", "line.*"))
    lines = materialise(lines)

    twice = lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")
    live = lines.join(twice, ["x", "y"])
    doc = ["_doc", "_body"]
    in_order = W.partitionBy(*doc).orderBy("at")
    live = live.withColumn("stretch", F.col("at") - F.row_number().over(in_order))
    here = W.partitionBy(*doc, "stretch")
    running = here.orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    live = (live.withColumn("upto", F.sum("w").over(running)).withColumn("total", F.max("upto").over(here))
            .where(F.col("total") >= min_words).drop("total"))
    live = materialise(live)

    # Shortest run of enough words from each line, and to each line: the words up to a line's end
    # (before its start) are sorted together with the counts that are sought.
    def spans(stop, sought, ascending: bool) -> DataFrame:
        mark = F.explode(F.array(F.struct(stop.alias("k"), F.lit(0).alias("q"), F.col("at").alias("p")),
                                 F.struct(sought.alias("k"), F.lit(1).alias("q"), F.lit(None).cast("int").alias("p"))))
        both = live.select(*doc, "stretch", "at", mark.alias("m")).select(*doc, "stretch", "at", "m.*")
        order = here.orderBy(F.col("k") if ascending else F.col("k").desc(), "q").rowsBetween(W.unboundedPreceding, 0)
        end = (F.max("p") if ascending else F.min("p")).over(order)
        return both.withColumn("other", end).where("q = 1 and other is not null").select(*doc, "at", "other")

    before = F.col("upto") - F.col("w")
    forward = spans(F.col("upto"), before + min_words, False).select(*doc, F.col("at").alias("a"), F.col("other").alias("b"))
    backward = spans(before, F.col("upto") - min_words, True).select(*doc, F.col("other").alias("a"), F.col("at").alias("b"))
    runs = forward.union(backward).distinct().withColumn("m", F.col("b") - F.col("a") + 1) \
        .withColumn("k", F.floor(F.log2("m")).cast("int"))
    runs = materialise(runs)
    levels = runs.agg(F.max("k")).first()[0] or 0

    named = live.select(*doc, "at", F.lit(0).alias("k"), "x", "y")
    level = live.select(*doc, "at", "x", "y")
    for k in range(1, levels + 1):
        step = 1 << (k - 1)
        far = W.partitionBy(*doc).orderBy("at").rangeBetween(step, step)
        level = (level.withColumn("x2", F.max("x").over(far)).withColumn("y2", F.max("y").over(far)).where("x2 is not null")
                 .select(*doc, "at", *[c.alias(n) for n, c in zip("xy", _name("x", "y", "x2", "y2"), strict=True)]))
        named = named.union(level.select(*doc, "at", F.lit(k).alias("k"), "x", "y"))
    if levels:
        named = materialise(named)
    head = named.select(*doc, F.col("at").alias("a"), "k", F.col("x").alias("x1"), F.col("y").alias("y1"))
    tail = named.select(*doc, F.col("at").alias("t"), "k", F.col("x").alias("x2"), F.col("y").alias("y2"))
    runs = (runs.withColumn("t", F.expr("b - shiftleft(1, k) + 1"))
            .join(head, [*doc, "a", "k"]).join(tail, [*doc, "t", "k"]))
    runs = materialise(runs.select(*doc, "a", "b", "m", "x1", "y1", "x2", "y2"))

    # The first copy of each run: in the smallest document, there at the smallest line.
    key = ["m", "x1", "y1", "x2", "y2"]
    per_doc = runs.groupBy(*key, *doc).agg(F.min("a").alias("a0"))
    first = per_doc.groupBy(*key).agg(F.min(F.struct("_doc", "_body", "a0")).alias("first"), F.count("*").alias("n"))
    later = runs.join(first, key).where("struct(_doc, _body, a) > first").select(*doc, "a", "b")
    by_start = W.partitionBy(*doc).orderBy("a", "b")
    reached = F.max("b").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    return (later.distinct().withColumn("opens", F.coalesce((F.col("a") > reached).cast("int"), F.lit(1)))
            .withColumn("span", F.sum("opens").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
            .groupBy(*doc, "span").agg(F.min("a").alias("a"), F.max("b").alias("b"))
            .groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone")))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs cut from ``text`` and lines_before, lines_removed added.

    A null text stays null (0 lines); an empty text has one empty line. Rows
    that repeat an id and its text are one document and get the same result;
    equal texts under different ids are copies. Columns named lines_before or
    lines_removed are replaced; all others pass through. Empty in, empty out.
    """
    doc, body = _document_key(docs, id_col, text_col)
    gone = repeated_lines(docs, min_words, id_col, text_col)
    parts = F.split(text_col, "\n")
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.exists("gone", lambda g: i.between(g["a"], g["b"]))), "\n")
    lost = F.aggregate("gone", F.lit(0), lambda n, g: n + g["b"] - g["a"] + 1)
    out = docs.withColumns({"_doc": doc, "_body": body}).join(gone, ["_doc", "_body"], "left")
    return (out.withColumn("lines_before", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)))
            .withColumn("lines_removed", F.coalesce(lost, F.lit(0)))
            .withColumn(text_col, F.when(F.col("gone").isNull(), F.col(text_col)).otherwise(kept))
            .drop("_doc", "_body", "gone"))
