"""Connected components by minimum labels and pointer jumping, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm._shared import delete, new_path


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of edges: component is the smallest node reachable.

    Direction, repeats and loops of edges do not matter; edges with a null end count as none. Each
    round gives every node the smallest label among its neighbours', and then the label of its
    label, so that long chains halve; it ends when no label changes. Rounds are written to the
    shared folder and the one before is deleted. Hub nodes only skew joins, which adaptive
    execution splits; the aggregations combine before their shuffle.
    """
    spark = edges.sparkSession

    def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = new_path(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    ends = edges.select(F.col(a).cast("bigint").alias("x"), F.col(b).cast("bigint").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    both = ends.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y").distinct()
    both, all_edges = keep(both, "edges")
    labels, old = keep(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("near"))
        moved = labels.join(near, "x").select("x", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # the label of the label: a label is itself a node, whose own label is as small or smaller
        jump = labels.select(F.col("x").alias("l"), F.col("label").alias("far"))
        moved = moved.join(jump, moved["label"] == jump["l"]).select("x", F.least("label", "far").alias("label"), "was")
        moved, path = keep(moved, "labels")
        changed = not moved.filter("label <> was").isEmpty()
        labels = moved.select("x", "label")
        delete(spark, old)
        old = path
        if not changed:
            delete(spark, all_edges)
            return labels.select(F.col("x").alias("node"), F.col("label").alias("component"))
