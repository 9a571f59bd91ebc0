"""Labelled edges: merging, exclusion, accuracy and drawing class. Edges are (n0 < n1, is_cross) with four flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["n0", "n1", "is_cross"]
FLAGS = ["is_candidate", "passes_filter", "is_selected", "is_reference"]

#: Colours by flag, with and without reference, and the colour of reference alone.
COLOURS = {"is_selected": ("#00C442", "#FF2800"), "passes_filter": ("#0658C2", "#FF9E00"), "is_candidate": ("#450BBA", "#FFDD00")}
REFERENCE_ONLY = "#C50094"


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("n0").alias("name")).union(edges.select("n1")).distinct()


def merge(*edges: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each key; a flag holds if it holds in any parallel edge. With ``parts``, edges are dealt into so many partitions first."""
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    if parts:
        out = out.repartition(parts, *KEY)
    return out.groupBy(*KEY).agg(*[F.bool_or(f).alias(f) for f in FLAGS])


def reference(edges: DataFrame) -> DataFrame:
    """Inferred edges as labelled ones."""
    return edges.select(*KEY, *[F.lit(f == "is_reference").alias(f) for f in FLAGS])


def exclude(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Without the edges of the named nodes."""
    for end in ("n0", "n1"):
        edges = edges.join(names.select(F.col("name").alias(end)), end, "left_anti")
    return edges.select(*KEY, *FLAGS)


def accuracy(edges: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and sensitivity (null for 0/0) of each label level against the reference; one pass, three rows."""
    levels = FLAGS[:3]
    r = F.col("is_reference")
    sums = [F.sum(F.when(c, 1).otherwise(0)).alias(f"{x}_{f}") for f in levels for x, c in (("tp", F.col(f) & r), ("fp", F.col(f) & ~r), ("fn", ~F.col(f) & r))]
    one = edges.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("level"), *[F.col(f"{x}_{f}").cast("long").alias(x) for x in ("tp", "fp", "fn")]) for f in levels])).alias("r")
    share = lambda other: F.round(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(other)).cast("double")), 6)
    return one.select(rows).select("r.*").select("level", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("sensitivity"))


def colour() -> Column:
    out = None
    for f, (with_reference, without) in COLOURS.items():
        c = F.when(F.col("is_reference"), with_reference).otherwise(without)
        out = F.when(F.col(f), c) if out is None else out.when(F.col(f), c)
    return out.when(F.col("is_reference"), REFERENCE_ONLY)


def depth() -> Column:
    """Drawing order of edges in the reference: selected 3, filtered 2, candidate 1, reference alone 4; 0 for others."""
    r = F.col("is_reference")
    return F.when(~r, 0).when(F.col("is_selected"), 3).when(F.col("passes_filter"), 2).when(F.col("is_candidate"), 1).otherwise(4)


def only(edges: DataFrame, flag: str) -> DataFrame:
    """Edges with a flag, such as those of the read graph (is_selected) or of the reference (is_reference)."""
    return edges.filter(F.col(flag))


def find(edges: DataFrame, asked: DataFrame, parts: int | None = None) -> DataFrame:
    """The edges between the asked pairs (columns a, b in either order, is_cross), with the pair as it was asked; pairs without an edge are left out."""
    keys = asked.select("a", "b", F.least("a", "b").alias("n0"), F.greatest("a", "b").alias("n1"), "is_cross")
    keys = (keys.repartition(parts, *KEY) if parts else keys).distinct()
    return keys.join(edges, KEY).select("a", "b", *KEY, *FLAGS)


def restrict(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Only the edges whose nodes are both named."""
    for end in ("n0", "n1"):
        edges = edges.join(names.select(F.col("name").alias(end)).distinct(), end, "left_semi")
    return edges.select(*KEY, *FLAGS)


def renamed(edges: DataFrame, names: DataFrame, parts: int | None = None) -> DataFrame:
    """Edges with the names of their ids (names: id, name) as a and b; edges of unknown ids are left out."""
    for end, name in (("n0", "a"), ("n1", "b")):
        edges = (edges.repartition(parts, end) if parts else edges).join(names.select(F.col("id").alias(end), F.col("name").alias(name)), end)
    return edges


def first_by_name(table: DataFrame, names: DataFrame) -> DataFrame:
    """name and the least id of the rows of ``table`` (id, name) with a name among ``names``."""
    return table.join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("id").alias("id"))
