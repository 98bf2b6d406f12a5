"""Connected components by repeated contraction, on written tables; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every end of an edge (a, b): comp is the smallest node reachable.

    Each round points every node at its smallest neighbour (or itself), jumps twice, and rewrites the edges between
    the nodes pointed at; a round at least halves the nodes that still have edges. Sums by node combine map-side, and
    joins are sort-merge joins between written tables, whose hot keys adaptive execution splits."""
    labels = None
    edges = written(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
        up = written(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("up")), "up")
        far = up.select(F.col("node").alias("__n"), F.col("up").alias("__far"))
        up = written(up.join(far, F.col("up") == F.col("__n")).select("node", F.col("__far").alias("comp")), "up2")
        if labels is None:
            labels = up
        else:
            moved = labels.join(up.select(F.col("node").alias("__n"), F.col("comp").alias("__c")), F.col("comp") == F.col("__n"), "left")
            labels = written(moved.select("node", F.coalesce("__c", "comp").alias("comp")), "labels")
        for end in ("a", "b"):
            edges = edges.join(up.select(F.col("node").alias("__n"), F.col("comp").alias("__c")), F.col(end) == F.col("__n")).drop(end, "__n").withColumnRenamed("__c", end)
        edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
