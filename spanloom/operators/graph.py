"""Double-stranded graphs: node 2 * name for the forward and 2 * name + 1 for the reverse strand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.scratch import new_path, stored


def double_stranded(edges: DataFrame) -> DataFrame:
    """Distinct edges u < v between strands: same-strand edges join like strands, cross-strand edges opposite ones."""
    flip = F.col("is_cross").cast("long")
    both = F.explode(F.array(*[F.struct((2 * F.col("n0") + s).alias("u"), (2 * F.col("n1") + (F.lit(s) + flip) % 2).alias("v")) for s in (0, 1)])).alias("x")
    return edges.select(both).select(F.least("x.u", "x.v").alias("u"), F.greatest("x.u", "x.v").alias("v")).distinct()


def distances(edges: DataFrame, start: list, radius: int | None = None) -> DataFrame:
    """node and distance (steps from the nearest of ``start``) up to ``radius``, or of all that can be reached.

    Each edge is stored once from either end, bucketed by that end, so a step shuffles
    its frontier and not the edges. In an undirected graph what is one step from the
    frontier and was visited before lies in the frontier or in the one before it: new nodes
    are held against these two alone. The search ends with an empty frontier.
    """
    spark = edges.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"adjacency_{uuid.uuid4().hex}"
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("far")).union(edges.select("v", "u"))
    both.write.bucketBy(parts, "node").sortBy("node").option("path", new_path(spark, "adjacency")).saveAsTable(name)
    try:
        near = spark.table(name)
        now = stored(spark.createDataFrame([(x,) for x in start], "node long").distinct(), "frontier")
        found, before, step = now.withColumn("distance", F.lit(0).cast("long")), now.limit(0), 0
        while (radius is None or step < radius) and now.limit(1).count():
            step += 1
            far = near.join(now, "node").select(F.col("far").alias("node")).distinct()
            fresh = stored(far.join(now, "node", "left_anti").join(before, "node", "left_anti"), "frontier")
            found = found.union(fresh.withColumn("distance", F.lit(step).cast("long")))
            before, now = now, fresh
    finally:
        # the files stay with the other intermediate tables
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return found


def subgraph(edges: DataFrame, start: list, radius: int) -> DataFrame:
    """Edges within ``radius`` steps of the start nodes: kept if their nearer end is fewer than ``radius`` steps away."""
    if radius < 1:
        return edges.limit(0).select("u", "v")
    inner = stored(distances(edges, start, radius - 1).select("node"), "inner")
    out = edges.join(inner.select(F.col("node").alias("u")), "u", "left_semi").select("u", "v")
    into = edges.join(inner.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v")
    return out.union(into).distinct()


def labels(names: DataFrame) -> DataFrame:
    """node and label of both strands of each name (column name): the name and + or -."""
    both = F.explode(F.array(*[F.struct((2 * F.col("name") + k).alias("node"), F.concat(F.col("name").cast("string"), F.lit(sign)).alias("label")) for k, sign in ((0, "+"), (1, "-"))])).alias("x")
    return names.select(both).select("x.node", "x.label")


def extent(nodes: DataFrame) -> DataFrame:
    """One row: the largest x and y of the nodes' coordinates."""
    return nodes.agg(F.max("x").alias("x_max"), F.max("y").alias("y_max"))
