"""Alignments step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions.scalars import consumes_query, consumes_reference


def segments(rows: DataFrame, keys: list[str], start: str, rev: str) -> DataFrame:
    """One row for each step of an alignment (``ops``; see ``cigar_ops``) but clips: step, op, and from x0, y0 to x1, y1 on reference and query.

    On the reverse strand the steps run from the end back, the last step first. Places
    are summed within the array of steps, so nothing is shuffled.
    """
    zero = F.lit(0).cast("long")
    move = lambda does, o: F.when(does(o["op"]), o["len"]).otherwise(0).cast("long")
    placed = "array<struct<k:bigint,op:string,x0:bigint,x1:bigint,y0:bigint,y1:bigint>>"
    begin = F.struct(F.array().cast(placed).alias("done"), F.col(start).cast("long").alias("x"), zero.alias("y"), zero.alias("k"))

    def step(acc, o):
        x, y = acc["x"] + move(consumes_reference, o), acc["y"] + move(consumes_query, o)
        here = F.struct(acc["k"].alias("k"), o["op"].alias("op"), acc["x"].alias("x0"), x.alias("x1"), acc["y"].alias("y0"), y.alias("y1"))
        return F.struct(F.concat(acc["done"], F.array(here)).alias("done"), x.alias("x"), y.alias("y"), (acc["k"] + 1).alias("k"))

    each = F.explode(F.aggregate("ops", begin, step, lambda acc: F.filter(acc["done"], lambda o: ~o["op"].isin("S", "H")))).alias("o")
    rows = rows.select(*keys, F.col(rev).alias("_rev"), F.size("ops").alias("_n"), each)
    turned = [F.when(F.col("_rev"), F.col(f"o.{c}{1 - k}")).otherwise(F.col(f"o.{c}{k}")).alias(f"{c}{k}") for c in "xy" for k in (0, 1)]
    at = F.when(F.col("_rev"), F.col("_n") - 1 - F.col("o.k")).otherwise(F.col("o.k")).cast("long").alias("step")
    return rows.select(*keys, at, F.col("o.op").alias("op"), *turned)
