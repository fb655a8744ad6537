"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pawgrid.llm.common import stage


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a long, b long); the label is one node of its component.

    A round points every node to its smallest neighbour (or itself), shortens the pointers until
    they end at roots, and replaces the edges by the distinct edges between roots; each round at
    least halves the nodes that still have an edge.  Everything stays in tables; the driver sees counts.
    """
    edges = stage(spark, edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges")
    found = stage(spark, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
                  .withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        roots = stage(spark, both.groupBy(F.col("a").alias("node")).agg(
            F.least(F.col("node"), F.min("b")).alias("root")), "roots")
        while True:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = stage(spark, roots.join(up, "root").select("node", F.col("next").alias("root"),
                                                               (F.col("next") != F.col("root")).alias("moved")), "roots")
            if roots.filter("moved").isEmpty():
                break
            roots = roots.drop("moved")
        roots = roots.select(F.col("node").alias("label"), "root")
        found = stage(spark, found.join(roots, "label", "left").select(
            "node", F.coalesce("root", "label").alias("label")), "labels")
        a = roots.select(F.col("label").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("label").alias("b"), F.col("root").alias("rb"))
        edges = stage(spark, edges.join(a, "a").join(b, "b").filter(F.col("ra") != F.col("rb")).select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return found
