"""Connected components of an undirected graph given as edges of long ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest id reachable from each node that has an edge.

    Each round points every node at its smallest neighbour, follows the pointers to their ends by doubling and contracts the edges; it
    stops when no edge between different roots is left. Minima are combined before shuffles, so a hub is no single task's work.
    """
    edges = written(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        pointers = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("to")), "pointers")
        while True:
            ends = pointers.select(F.col("node").alias("to"), F.col("to").alias("end"))
            further = written(pointers.join(ends, "to").select("node", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")), "pointers")
            moved = not further.where("moved").isEmpty()
            pointers = further.select("node", "to")
            if not moved:
                break
        root = pointers.select(F.col("node").alias("root"), F.col("to"))
        labels = written(labels.join(root, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        ends_a, ends_b = (pointers.select(F.col("node").alias(x), F.col("to").alias(f"{x}_to")) for x in "ab")
        contracted = edges.join(ends_a, "a").join(ends_b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = written(contracted.where("a <> b").distinct(), "edges")
    return labels
