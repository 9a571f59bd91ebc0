"""Running sums, ranks and neighbours over a total order, without bringing a group's rows into one task.

Rows lie in consecutive buckets of the order; bucket totals are summed over the small
table of buckets, and exact order is settled within each bucket. The bucket number
must not fall as the order rises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.scratch import stored


def running(df: DataFrame, group: list[str], bucket: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its column over all rows of the group that come before.

    The group's columns and the bucket must not be null, and ``order`` must settle
    ties within a bucket. The running sums of the table of bucket totals go by
    thousands of buckets themselves.
    """
    keys = [*group, bucket]
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = df.groupBy(*keys).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()]).withColumn("_wide", F.floor(F.col(bucket) / 1000))
    coarse = totals.groupBy(*group, "_wide").agg(*[F.sum(f"_t_{k}").alias(f"_w_{k}") for k in sums])
    over_wide = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_wide")
    coarse = coarse.select(*group, "_wide", *[before(over_wide, f"_w_{k}").alias(f"_c_{k}") for k in sums])
    fine = Window.partitionBy(*group, "_wide").orderBy(bucket)
    totals = totals.select(*keys, "_wide", *[before(fine, f"_t_{k}").alias(f"_f_{k}") for k in sums])
    offsets = totals.join(coarse, [*group, "_wide"]).select(*keys, *[(F.col(f"_f_{k}") + F.col(f"_c_{k}")).alias(f"_b_{k}") for k in sums])
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.select("*", *[before(within, c).alias(f"_r_{k}") for k, c in sums.items()])
    return ranked.join(offsets, keys).select(*df.columns, *[(F.col(f"_r_{k}") + F.col(f"_b_{k}")).alias(k) for k in sums])


def sorted_running(df: DataFrame, order: list[Column], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """``running`` in any total order: the buckets are the ranges of Spark's own sort by group and order. Null groups are groups."""
    group = group or []
    own = {"_group": F.struct(*group)} if group else {}
    ranged = stored(df.orderBy(*group, *order).withColumns({"_range": F.spark_partition_id().cast("long"), **own}), "sorted")
    return running(ranged, list(own), "_range", order, sums).drop("_range", "_group")


def with_next(df: DataFrame, group: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """``df`` with columns of the next row of its group (new name: column); rows without a next one are left out. Null groups are groups."""
    ranked = stored(sorted_running(df, order, {"_place": F.lit(1)}, group), "ranked").withColumn("_group", F.struct(F.lit(0), *group))
    behind = ranked.select("_group", (F.col("_place") - 1).alias("_place"), *[F.col(c).alias(n) for n, c in columns.items()])
    return ranked.join(behind, ["_group", "_place"]).select(*df.columns, *columns)
