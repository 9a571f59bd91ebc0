"""Chains of alignments: order along the read, gaps between neighbours, and islands between large gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_GAP, PENALTY = 2000, 500
ORDER = ["ord", "line", "part", "s", "e", "contig", "rev"]


def gap(a: str = "prev") -> Column:
    """Distance from element ``a`` (a struct column) to the current one.

    On one contig: 0 if they overlap in forward-oriented coordinates (start after
    stop on the reverse strand, so two reverse elements never overlap), else from
    the one's stop to the other's start. On two: both distances to the contig's end
    plus a penalty.
    """
    of = lambda c: F.col(f"{a}.{c}")
    a0, a1 = F.when(of("rev"), of("e")).otherwise(of("s")), F.when(of("rev"), of("s")).otherwise(of("e"))
    b0, b1 = F.when(F.col("rev"), F.col("e")).otherwise(F.col("s")), F.when(F.col("rev"), F.col("s")).otherwise(F.col("e"))
    end = lambda rev, s, e, n: F.when(rev, s).otherwise(n - e)
    apart = end(of("rev"), of("s"), of("e"), of("contig_length")) + end(F.col("rev"), F.col("s"), F.col("e"), F.col("contig_length")) + PENALTY
    near = F.when((a1 > b0) & (a0 < b1), F.lit(0).cast("long")).otherwise(F.abs(a1 - b0))
    return F.when(of("contig") == F.col("contig"), near).otherwise(apart)


def of_quality(elements: DataFrame, least: float, quality: str = "quality") -> DataFrame:
    """Elements that take part in chains: those of a quality of ``least`` or more."""
    return elements.filter(F.col(quality) >= least).drop(quality)


def gaps(elements: DataFrame) -> DataFrame:
    """Elements with their place (from 0) in the read's chain and the gap to the one before (null for the first)."""
    w = Window.partitionBy("read").orderBy(*ORDER)
    before = F.lag(F.struct("contig", "contig_length", "s", "e", "rev")).over(w)
    return elements.withColumns({"place": (F.row_number().over(w) - 1).cast("long"), "prev": before}).withColumn("gap", F.when(F.col("prev").isNotNull(), gap())).drop("prev")


def islands(elements: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """``gaps`` with the island of each element, from 0: a gap over ``max_gap`` begins a new one."""
    w = Window.partitionBy("read").orderBy("place")
    cut = F.when(F.col("gap") > max_gap, 1).otherwise(0)
    return gaps(elements).withColumn("island", F.sum(cut).over(w).cast("long"))


def chimeric(elements: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """For each read: elements, islands, bases, and whether it is chimeric (more than one island)."""
    per = islands(elements, max_gap).groupBy("read").agg(F.count("*").alias("n_elements"), (F.max("island") + 1).alias("n_islands"), F.sum("length").alias("bases"))
    return per.withColumn("is_chimeric", F.col("n_islands") > 1)


def subchain_bounds(elements: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """For each island: first and last place, the first element's start, the last one's stop, rows and bases."""
    return islands(elements, max_gap).groupBy("read", "island").agg(
        F.min("place").alias("first_place"),
        F.max("place").alias("last_place"),
        F.min_by("s", "place").alias("start"),
        F.max_by("e", "place").alias("stop"),
        F.count("*").alias("n_elements"),
        F.sum("length").alias("bases"),
    )


def best_by(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def strand_flips(elements: DataFrame) -> DataFrame:
    """For each read: contigs met and changes of strand between neighbours."""
    w = Window.partitionBy("read").orderBy(*ORDER)
    flip = F.when(F.lag("rev").over(w) != F.col("rev"), 1).otherwise(0)
    return elements.withColumn("flip", flip).groupBy("read").agg(F.countDistinct("contig").alias("n_contigs"), F.sum("flip").alias("n_flips"))


def chimera_files(elements: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """(kind, value) of the six outputs: names and lengths of chimeric and of other reads, and lengths and coordinates of chimeric reads' subchains."""
    placed = islands(elements, max_gap)
    whole = F.struct(F.col("length").alias("length"), F.abs(F.col("e") - F.col("s")).alias("span"), F.col("s").alias("s"), F.col("e").alias("e"))
    parts = placed.groupBy("read", "island").agg(F.min_by("s", "place").alias("start"), F.max_by("e", "place").alias("stop"), F.collect_list(whole["span"]).alias("spans"), F.sum("length").alias("bases"))
    read = parts.groupBy("read").agg(F.count("*").alias("n"), F.sum("bases").alias("bases"), F.sort_array(F.collect_list(F.struct("island", "start", "stop", "spans"))).alias("parts"))
    kind = lambda yes, no: F.when(F.col("n") > 1, yes).otherwise(no)
    one = lambda k, v: F.array(F.struct(k.alias("kind"), v.cast("string").alias("value")))
    bounds = F.array_join(F.transform("parts", lambda p: F.concat(F.lit("("), p["start"].cast("string"), F.lit(","), p["stop"].cast("string"), F.lit(")"))), ",")
    spans = F.transform(F.flatten(F.col("parts.spans")), lambda x: F.struct(F.lit("subchain_lengths").alias("kind"), x.cast("string").alias("value")))
    own = F.concat(one(kind("chimeric_reads", "other_reads"), F.col("read")), one(kind("chimeric_lengths", "other_lengths"), F.col("bases")))
    chimeric = F.concat(own, one(F.lit("subchains"), F.concat_ws("\t", F.col("read").cast("string"), bounds)), spans)
    return read.select(F.explode(F.when(F.col("n") > 1, chimeric).otherwise(own)).alias("x")).select("x.kind", "x.value")


def chimera_stats(reads: DataFrame, by: str) -> DataFrame:
    """For each group of ``chimeric`` rows: n50 of the bases, chimeric reads and others. n50 is the least length with half of all bases in reads of up to it."""
    sizes = reads.groupBy(by, "bases").agg(F.count("*").alias("n"), F.sum(F.col("is_chimeric").cast("long")).alias("c"))
    w = Window.partitionBy(by)
    run = sizes.withColumns({"upto": F.sum(F.col("n") * F.col("bases")).over(w.orderBy("bases")), "all": F.sum(F.col("n") * F.col("bases")).over(w)})
    half = F.min(F.when(2 * F.col("upto") >= F.col("all"), F.col("bases"))).alias("n50")
    return run.groupBy(by).agg(half, F.sum("c").alias("n_chimeric"), F.sum(F.col("n") - F.col("c")).alias("n_others"))
