"""Interval joins and coverage of half-open intervals [s, e) by target. Empty intervals (s >= e) take no part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.scratch import stored
from spanloom.operators.blocks import BOUND, self_pairs
from spanloom.operators.prefix import sorted_running

#: Width of a bin; about the length of the longest common intervals is best.
WIDTH = 64


def bins(s: Column, e: Column, width: int) -> Column:
    """All bins that [s, e) touches."""
    return F.sequence(F.floor(s / width), F.floor((e - 1) / width))


def overlap_edges(aln: DataFrame, min_quality: int, width: int | None = WIDTH, bound: int = BOUND) -> DataFrame:
    """Distinct undirected strand-aware edges between different reads that overlap on a target: n0 < n1, is_cross.

    Intervals are dealt into bins, so a target with many rows becomes many join
    keys, and a bin with more than ``bound`` intervals becomes pairs of blocks; a pair
    counts in the bin where its overlap begins, hence once. Equal edges are made one before
    they are shuffled. A ``width`` of None joins by target alone.
    """
    rows = aln.filter((F.col("mapq") >= min_quality) & (F.col("s") < F.col("e"))).select("target", "query", "s", "e", "rev")
    meet = lambda a, b: (F.col(f"{a}.s") < F.col(f"{b}.e")) & (F.col(f"{b}.s") < F.col(f"{a}.e")) & (F.col(f"{a}.query") < F.col(f"{b}.query"))
    if width:
        rows = rows.withColumn("bin", F.explode(bins(F.col("s"), F.col("e"), width)))
        here = lambda a, b: meet(a, b) & (F.col(f"{a}.bin") == F.floor(F.greatest(f"{a}.s", f"{b}.s") / width))
        pairs = self_pairs(rows, ["target", "bin"], here, bound)
    else:
        pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.target") == F.col("b.target")) & meet("a", "b"))
    return pairs.select(F.col("a.query").alias("n0"), F.col("b.query").alias("n1"), (F.col("a.rev") != F.col("b.rev")).alias("is_cross")).distinct()


def settled_bins(rows: DataFrame, width: int) -> DataFrame:
    """target, bin, at, stop, ids: the segments of each bin, of ``rows`` (target, s, e, id) clipped to it; equal neighbours are one."""
    low, high = F.col("bin") * width, (F.col("bin") + 1) * width
    clipped = rows.withColumn("bin", F.explode(bins(F.col("s"), F.col("e"), width))).select("target", "bin", F.greatest("s", low).alias("s"), F.least("e", high).alias("e"), "id")
    of_bin = Window.partitionBy("target", "bin").orderBy("at")
    cuts = clipped.select("target", "bin", F.explode(F.array("s", "e")).alias("at")).distinct()
    segments = cuts.withColumn("stop", F.lead("at").over(of_bin)).filter("stop is not null")
    inside = (F.col("s") <= F.col("at")) & (F.col("at") < F.col("e"))
    sets = segments.join(clipped, ["target", "bin"]).filter(inside).groupBy("target", "bin", "at", "stop").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    same = (F.lag("stop").over(of_bin) == F.col("at")) & (F.lag("ids").over(of_bin) == F.col("ids"))
    marked = sets.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(of_bin))
    return marked.groupBy("target", "bin", "island").agg(F.min("at").alias("at"), F.max("stop").alias("stop"), F.first("ids").alias("ids")).drop("island")


def coverage_segments(aln: DataFrame, min_quality: int, width: int = WIDTH) -> DataFrame:
    """target, seg_start, seg_stop, n_ids and ids: the strand ids (2 * query + rev) that cover each stretch; equal neighbours are one.

    Segments are settled within each bin of a target. Those that meet an equal one at the
    border of two bins are then put together: they alone are numbered along the target,
    in buckets of the order, so no target is gone through in one task.
    """
    rows = aln.filter((F.col("mapq") >= min_quality) & (F.col("s") < F.col("e"))).select("target", "s", "e", (2 * F.col("query") + F.col("rev").cast("long")).alias("id"))
    parts = stored(settled_bins(rows, width).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ",")), "segments")
    # what ends at a border, and what begins there: at most one of each
    border = lambda c: F.col(c) % width == 0
    ends = parts.filter(border("stop")).select("target", F.col("stop").alias("seam"), "ids")
    begins = parts.filter(border("at")).select("target", F.col("at").alias("seam"), "ids")
    seams = stored(ends.join(begins, ["target", "seam", "ids"]).select("target", "seam"), "seams")
    left, right = seams.select("target", F.col("seam").alias("stop"), F.lit(True).alias("goes_on")), seams.select("target", F.col("seam").alias("at"), F.lit(True).alias("came_from"))
    marked = parts.join(left, ["target", "stop"], "left").join(right, ["target", "at"], "left")
    alone = marked.filter("goes_on is null and came_from is null")
    joined = marked.filter("goes_on or came_from").select("target", "at", "stop", "ids", F.when(F.col("came_from"), 0).otherwise(1).alias("new"))
    # a first part counts in its own number, the parts behind it in the number before them
    numbered = sorted_running(joined, [F.col("target"), F.col("at")], {"_before": F.col("new")}).withColumn("island", F.col("_before") + F.col("new"))
    merged = numbered.groupBy("island").agg(F.first("target").alias("target"), F.min("at").alias("at"), F.max("stop").alias("stop"), F.first("ids").alias("ids"))
    whole = alone.select("target", "at", "stop", "ids").unionByName(merged.drop("island"))
    return whole.select("target", F.col("at").alias("seg_start"), F.col("stop").alias("seg_stop"), F.size(F.split("ids", ",")).cast("long").alias("n_ids"), "ids")
