"""Connected components by repeated contraction, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (node, component: smallest node of its component).

    Each round points every node at its smallest neighbour, follows the
    pointers to their roots (four steps a table, so shallow trees need one),
    and contracts the edges onto the roots. Nodes and edges stay distributed
    and every step is a written table. Nulls and loops in ``edges`` are
    ignored; no edges give no rows.
    """
    live = materialise(edges.where("a is not null and b is not null and a <> b")
                       .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        point = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
                            .select("node", F.least("node", "to").alias("to")))
        while True:
            far = point
            for k in range(3):
                step = point.select(F.col("node").alias("to"), F.col("to").alias("next"))
                far = far.join(step, "to").select("node", F.col("next").alias("to"), (F.col("next") < F.col("to")).alias("moved"))
            point = materialise(far)
            if point.where("moved").isEmpty():
                break
            point = point.drop("moved")
        roots = point.select("node", F.col("to").alias("component"))
        if label is not None:
            step = roots.withColumnRenamed("node", "old").withColumnRenamed("component", "new")
            roots = materialise(label.withColumnRenamed("component", "old").join(step, "old", "left")
                                .select("node", F.coalesce("new", "old").alias("component")))
        label = roots
        ends = point.select("node", "to")
        live = materialise(live.join(ends.toDF("a", "ta"), "a").join(ends.toDF("b", "tb"), "b").where("ta <> tb")
                           .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    return label if label is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component"))
