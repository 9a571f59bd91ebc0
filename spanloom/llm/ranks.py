"""Sizes of the buckets in which rows of a hashed order are ranked (see ``operators.prefix``).

Callers derive the bucket from a hashed key whose distribution they know, with a
number of buckets in proportion to the rows, so buckets stay near one size whatever
the size of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.llm.lookups import HOT_ROWS, MOST_HOT
from spanloom.operators.prefix import running, sorted_running

__all__ = ["ROWS_A_BUCKET", "buckets_for", "running", "sorted_running", "split_equal"]
#: Rows that a bucket holds on average.
ROWS_A_BUCKET = 2000


def buckets_for(rows: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(rows / ROWS_A_BUCKET)).cast("long")


def split_equal(rows: DataFrame, group: str, bucket: str, key: str, row: str) -> DataFrame:
    """Stored ``rows`` with buckets in which rows of one ``key`` are dealt over several, in the same order of keys.

    A key is hot with more than HOT_ROWS rows, and than rows / MOST_HOT, so the table of
    hot keys is small enough to broadcast at any size. A bucket with hot keys becomes
    one for each of them, cut again by a hash of ``row``, and one for each gap between
    them. Which of the rows of one key comes first is settled by that hash.
    """
    bound = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot = rows.groupBy(group, bucket, key).agg(F.count("*").alias("_n")).filter(F.col("_n") > bound)
    hot = F.broadcast(hot.groupBy(group, bucket).agg(F.collect_list(F.struct(F.col(key).alias("k"), "_n")).alias("_hot")))
    below = F.size(F.filter("_hot", lambda h: h["k"] < F.col(key)))
    own = F.get(F.filter("_hot", lambda h: h["k"] == F.col(key)), F.lit(0))["_n"]
    salt = F.when(own.isNotNull(), F.pmod(F.xxhash64(row), F.least(F.lit(1024), F.ceil(own / ROWS_A_BUCKET)))).otherwise(0)
    part = F.when(F.col("_hot").isNull(), 0).otherwise(F.least(F.lit(63), 2 * below + own.isNotNull().cast("int")))
    return rows.join(hot, [group, bucket], "left").withColumn(bucket, F.col(bucket) + (part * 1024 + salt) / F.lit(65536.0)).select(*rows.columns)
