"""Connected components of an edge list, by rounds of joins: one way at every size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import cut, drop, stored


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id of its component, for all ids in the links (a, b) of different ids; ids of any ordered type.

    Each round every component so far goes to the smallest one that a link leads to, and pointers jump; the number of
    rounds is about the logarithm of the longest path. Tables are written and read again each round: a checkpoint keeps
    the size that the optimizer had guessed, and guesses of joins of joins grow without end.
    """
    spark = links.sparkSession
    both, path = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    paths = [path]
    label, path = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("label")), "labels")
    paths.append(path)
    after = lambda step: step.join(step.select(F.col("label").alias("up"), F.col("up").alias("next")), "up").select("label", F.col("next").alias("up"))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        step = label.join(near, "id").groupBy("label").agg(F.min("near").alias("near")).select("label", F.least("label", "near").alias("up"))
        step, path = stored(step, "steps")
        paths.append(path)
        if step.where("label <> up").isEmpty():
            break
        label, path = stored(label.join(after(after(step)), "label").select("id", F.col("up").alias("label")), "labels")
        paths.append(path)
    label = cut(label)
    for path in paths:
        drop(spark, path)
    return label


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest id of each node's component: edges (part, a, b) to (part, id, component), parts apart from each other.

    Edges of a node with itself make it known as a component of its own.
    """
    node = lambda c: F.struct(F.col("part").cast("int").alias("part"), F.col(c).cast("long").alias("id")).alias(c)
    found = components(edges.select(node("a"), node("b"))).select("id.part", "id.id", F.col("label.id").alias("component"))
    alone = edges.where("a = b").select(F.col("part").cast("int").alias("part"), F.col("a").cast("long").alias("id")).distinct()
    alone = alone.join(found, ["part", "id"], "left_anti").withColumn("component", F.col("id"))
    return found.unionByName(alone)
