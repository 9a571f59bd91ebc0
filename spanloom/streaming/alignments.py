"""Alignment lines as a stream: parsed, filtered, and counted by target. The overlap join keeps to batches, as its state has no bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.sources.formats import parse_alignments


def alignment_stream(spark: SparkSession, path: str, min_quality: int = 0) -> DataFrame:
    return parse_alignments(spark.readStream.text(path)).filter(F.col("mapq") >= min_quality)


def coverage_by_target(rows: DataFrame) -> DataFrame:
    """Alignments and aligned bases of each target so far; for output mode complete or update."""
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.sum(F.col("target_stop") - F.col("target_start")).alias("bases"))
