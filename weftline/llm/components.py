"""Connected components of an edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs to rows (node, comp), comp the smallest node that is reachable.

    Each round joins the labels across the edges, takes the least and jumps once more over the
    label's own label, so that a chain of n nodes takes about log n rounds; a star takes two. Edges
    inside one component are dropped as rounds go. Labels are written to the shared folder every
    round. An empty edge table gives no rows; self-edges and repeated edges are harmless; edges with
    a null end are left out.
    """
    e = edges.where("a is not null and b is not null").select("a", "b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = written(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    for _ in range(most_rounds):
        far = e.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = label.join(far, "node").select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        jump = label.select(F.col("node").alias("new"), F.col("comp").alias("over"))
        new = written(step.join(jump, "new", "left").select("node", "old", F.least("new", F.coalesce("over", "new")).alias("comp")), "labels")
        label = new.select("node", "comp")
        if new.where("comp <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")
