"""Comparison of sets and of two binary assignments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def set_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b and both: counts of distinct values of two one-column tables, in one shuffle."""
    name = a.columns[0]
    rows = a.select(F.col(name).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(F.col(b.columns[0]), F.lit(0), F.lit(1)))
    per = rows.groupBy("x").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return per.agg(n((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), n((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"), n((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


def confusion(rows: DataFrame, by: str = "component") -> DataFrame:
    """The 2 x 2 table of assignments a and b for each component, and its size."""
    n = lambda a, b: F.sum(F.when((F.col("a") == a) & (F.col("b") == b), 1).otherwise(0)).cast("long").alias(f"n{a}{b}")
    return rows.groupBy(by).agg(*[n(a, b) for a in (0, 1) for b in (0, 1)], F.count("*").alias("n"))


def adjusted_rand(table: DataFrame) -> DataFrame:
    """``confusion`` rows with the adjusted Rand index in closed form; null where it is undefined."""
    c2 = lambda x: x * (x - 1) / 2
    cells: list[Column] = [F.col(f"n{a}{b}").cast("double") for a in (0, 1) for b in (0, 1)]
    index = sum((c2(x) for x in cells[1:]), c2(cells[0]))
    rows = c2(cells[0] + cells[1]) + c2(cells[2] + cells[3])
    columns = c2(cells[0] + cells[2]) + c2(cells[1] + cells[3])
    expected = F.try_divide(rows * columns, c2(F.col("n").cast("double")))
    return table.withColumn("ari", F.round(F.try_divide(index - expected, (rows + columns) / 2 - expected), 6))


def discordant(rows: DataFrame, table: DataFrame, by: str = "component") -> DataFrame:
    """Rows that go against their component's majority pairing (a = b, or a <> b); a tie counts as a = b."""
    side = table.select(by, (F.col("n00") + F.col("n11") >= F.col("n01") + F.col("n10")).alias("alike"))
    return rows.join(side, by).filter((F.col("a") == F.col("b")) != F.col("alike")).select(*rows.columns)


def checked_sides(rows: DataFrame, name: str, phase: str) -> DataFrame:
    """name and phase of each read of one assignment; a read in both phases makes the read fail."""
    per = rows.groupBy(name).agg(F.min(phase).alias(phase), F.max(phase).alias("_other"))
    return per.filter(F.when(F.col(phase) == F.col("_other"), True).otherwise(F.raise_error(F.lit("a read is in both haplotypes")))).drop("_other")


def refuse_conflicts(rows: DataFrame, name: str, phases: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """``rows`` as they are; a read that stands in both haplotypes of one assignment makes the read fail."""
    same = Window.partitionBy(name)
    split = [F.min(c).over(same) < F.max(c).over(same) for c in phases]
    bad = reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in split])
    checked = rows.withColumn("_bad", bad & F.col(name).isNotNull())
    return checked.filter(F.when(F.col("_bad"), F.raise_error(F.lit("a read is in both haplotypes")).cast("boolean")).otherwise(True)).drop("_bad")
