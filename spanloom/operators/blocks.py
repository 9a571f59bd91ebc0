"""Self-joins whose keys may hold very many rows: such a key becomes a grid of blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.functions.scratch import stored

#: Rows of one key that are compared with each other in one group.
BOUND = 2000
#: Keys with more rows that are broadcast; with more such keys, rows are joined with them by a shuffle.
MOST_HOT = 50_000


def partitions(rows: DataFrame, each: int = 500_000) -> int:
    """Partitions with about ``each`` of the rows, at least as many as shuffles have: a task's memory then stays as it is when the table grows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))


def hot_keys(rows: DataFrame, keys: list[str], bound: int, most: int = MOST_HOT, having: Column | None = None) -> DataFrame | None:
    """keys and _n of the keys with more than ``bound`` rows and for which ``having`` holds, to be joined; None if there are none."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"), (F.lit(True) if having is None else having).alias("_held"))
    counts = counts.filter((F.col("_n") > bound) & F.col("_held")).drop("_held")
    found = counts.limit(most + 1).collect()
    if not found:
        return None
    if len(found) > most:
        return stored(counts, "hot-keys")
    return F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema))


def self_pairs(rows: DataFrame, keys: list[str], on: Callable[[str, str], Column], bound: int = BOUND) -> DataFrame:
    """Pairs of ``rows``, as aliases a and b, with equal ``keys`` for which ``on("a", "b")`` holds.

    A key with n rows, more than ``bound``, is cut in k = n / bound blocks of rows by a hash
    of their number; each of the k * k pairs of blocks is a join key of its own, so no task compares
    more than about bound * bound rows of one key, and n rows are repeated k times. ``rows``
    must come from a scan without a shuffle, so that a row's number is the same in every
    attempt of its task.
    """
    same = lambda names: reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in names])
    hot = hot_keys(rows, keys, bound)
    if hot is None:
        return rows.alias("a").join(rows.alias("b"), same(keys) & on("a", "b"))
    cold = rows.join(hot, keys, "left_anti").withColumns({"_i": F.lit(0), "_j": F.lit(0)}).select(*rows.columns, "_i", "_j")
    many = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, keys).withColumn("_k", F.ceil(F.col("_n") / bound).cast("int"))
    own = F.pmod(F.xxhash64("_row"), F.col("_k")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    left = cold.unionByName(many.withColumns({"_i": own, "_j": others}).select(*cold.columns))
    right = cold.unionByName(many.withColumns({"_j": own, "_i": others}).select(*cold.columns))
    # blocks take far longer than their bytes tell, so they are dealt over all partitions and not put together again
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = lambda side: side.repartition(parts, *keys, "_i", "_j")
    return deal(left).alias("a").join(deal(right).alias("b"), same([*keys, "_i", "_j"]) & on("a", "b"))


def two_sided(left: DataFrame, right: DataFrame, keys: list[str], bound: int = BOUND) -> DataFrame:
    """The join of two stored tables on ``keys``. A key with more than ``bound`` * ``bound`` pairs is cut in blocks on both sides."""
    counts = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    both = counts(left, "_l").join(counts(right, "_r"), keys).filter(F.col("_l") * F.col("_r") > bound * bound)
    found = both.limit(MOST_HOT + 1).collect()
    if not found:
        return left.join(right, keys)
    hot = stored(both, "hot-keys") if len(found) > MOST_HOT else F.broadcast(left.sparkSession.createDataFrame(found, both.schema))

    def dealt(rows: DataFrame, own: str, n: str, other: str, m: str) -> DataFrame:
        cold = rows.join(hot, keys, "left_anti").withColumns({own: F.lit(0), other: F.lit(0)})
        blocks = lambda c: F.ceil(F.col(c) / bound)
        many = rows.withColumn("_row", F.monotonically_increasing_id()).join(hot, keys)
        many = many.withColumns({own: F.pmod(F.xxhash64("_row"), blocks(n)).cast("int"), other: F.explode(F.sequence(F.lit(0), blocks(m).cast("int") - 1))})
        return cold.unionByName(many.select(*cold.columns))

    on = [*keys, "_i", "_j"]
    return dealt(left, "_i", "_l", "_j", "_r").join(dealt(right, "_j", "_r", "_i", "_l"), on).drop("_i", "_j")
