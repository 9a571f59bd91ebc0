"""What the operators share: scratch tables, word splitting and let-bindings for column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanloom.functions.scratch import drop_stored, shared_dir, small_side, stored, written
from spanloom.functions.shipping import ship_package

__all__ = ["documents", "drop_stored", "fold", "let", "shared_dir", "small_side", "stored", "text_key", "text_or_empty", "words", "written"]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` in a text, in order; none for null or blank texts."""
    return F.array_remove(F.split(text_or_empty(text), r"[\x20\x09-\x0D]+"), "")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text (null: empty); equal keys mean equal texts."""
    return F.unhex(F.md5(text_or_empty(text)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids fall into fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))
