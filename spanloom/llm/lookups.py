"""Joins of many rows with a table of keys: no hot key meets one task, and no row is shuffled that cannot match."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot with more rows than this, and than total rows / MOST_HOT; so there are never more than MOST_HOT hot keys.
HOT_ROWS, MOST_HOT = 1000, 50_000
#: Words of 64 bits that a sieve has at most.
MOST_WORDS = 1 << 20


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row for each ``key`` and in ``n`` the number of rows that hold it.

    The entries of hot keys are broadcast: MOST_HOT of them at most, whatever the size
    of the input. All others are joined by a shuffle in which a key has few rows.
    ``rows`` is read twice and should be stored or cheap.
    """
    bound = max(HOT_ROWS, rows.count() // MOST_HOT)
    hot, cold = F.broadcast(table.filter(F.col(n) > bound)), table.filter(F.col(n) <= bound)
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    of_hot = rows.join(hot, key).select(*columns)
    return of_hot.unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left").select(*columns))


def attach(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """``lookup``, with the whole table broadcast where it was found to have MOST_HOT rows at most; ``rows`` is read once then."""
    if table.limit(MOST_HOT + 1).count() > MOST_HOT:
        return lookup(rows, table, key, n)
    columns = [*rows.columns, *[c for c in table.columns if c != key]]
    return rows.join(F.broadcast(table), key, "left").select(*columns)


@dataclass
class Sieve:
    """A Bloom filter as a table of 64-bit words with four bits for each key: it passes all of the keys and few other values.

    There are 16 bits for each key up to MOST_WORDS words; with more keys it passes
    more, and the exact join behind it has more to do, but nothing is lost.
    """

    words: int
    table: DataFrame

    @staticmethod
    def _placed(key: Column, words: int) -> tuple[Column, Column]:
        h = F.xxhash64(key, F.lit(17))
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 20 + 6 * k).bitwiseAND(63).cast("int"))
        return h.bitwiseAND(F.lit(words - 1)), bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).bitwiseOR(bit(3))

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> Sieve:
        """The sieve of a stored table's column, in which keys may stand more than once."""
        words = min(MOST_WORDS, 1 << max(0, (keys.count() // 4).bit_length()))
        at, bits = cls._placed(F.col(key), words)
        return cls(words, keys.select(at.alias("_word"), bits.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))

    def marked(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """``rows`` with the boolean ``name``: false where the key is surely not among the sieve's."""
        at, bits = self._placed(F.col(key), self.words)
        known = F.broadcast(self.table.withColumnRenamed("_bits", "_known"))
        marked = rows.withColumns({"_word": at, "_bits": bits}).join(known, "_word", "left")
        return marked.select(*rows.columns, F.coalesce(F.col("_known").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False)).alias(name))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` stands in ``gone`` (stored, one column).

    Only rows that a sieve of ``gone`` passes are shuffled for the exact anti-join.
    """
    marked = Sieve.of(gone, key).marked(rows, key, "_maybe")
    kept = marked.filter("_maybe").join(gone, key, "left_anti")
    return marked.filter("not _maybe").unionByName(kept.select(*marked.columns)).drop("_maybe")
