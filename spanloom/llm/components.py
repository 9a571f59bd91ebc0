"""Connected components of an edge table by alternating large and small stars, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.llm.common import stored
from spanloom.llm.lookups import lookup


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v of one orderable type) that is not its component's least node.

    Each round links a node's larger neighbours, then its smaller ones, to the
    least of them; rounds grow with the logarithm of the longest path. Each round
    is written to the shared folder. Minima are combined before they are shuffled,
    and those of hubs are broadcast (see ``lookup``).
    """
    ordered = lambda df: df.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    now = stored(ordered(edges), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = lookup(both, least, "u", "n").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(ordered(large.union(least.select("u", F.col("m").alias("v")))), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = lookup(large, least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(ordered(small.union(least.select("u", F.col("m").alias("v")))), "edges")
        before, seen = seen, mark(now)
        if seen == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
