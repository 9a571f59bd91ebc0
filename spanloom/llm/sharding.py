"""Operator 8, sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded hashed order, and sorted over all
sources by fractional rank (rank + 1/2) / rows of the source. Equal cuts of that
order give shards whose row counts differ by one at most and whose sources stand
in the proportions of the whole. Both orders use bucketed ranks, and the rows of an id
and text that repeats often are dealt over several buckets, so no source, no shard and
no group of equal rows has to fit into one task.

The law is ``rows``. Defined results: null text has size 8; a text of any length is one
row; null sources form a source of their own; null or repeated ids and fully repeated
rows are ordered by id and text checksum, and rows equal in all of these are
interchangeable. Fewer rows than shards leave the last shards empty. Empty tables give
empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, stored, text_key, text_or_empty
from spanloom.llm.lookups import attach
from spanloom.llm.ranks import buckets_for, running, split_equal

SHARDS, SEED = 24, 11


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row, with the columns in ``keep`` (the text, to write shards)."""
    whole = text_or_empty(F.col(text))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("")), text_key(F.col(text)))
    size = (F.octet_length(whole) + 8).cast("long")
    rows = stored(docs.select(F.col(id).alias("doc_id"), size.alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.col(source).alias("_source"), key.alias("_key"), F.monotonically_increasing_id().alias("_row"), *keep), "shard-rows")
    counts = stored(rows.groupBy("_source").agg(F.count("*").alias("_n")).select(F.struct("_source").alias("_s"), F.xxhash64("_source").alias("_sid"), "_n"), "shard-sources")
    total = rows.count()
    rows = attach(rows.withColumn("_s", F.struct("_source")), counts, "_s", "_n").drop("_s")
    # the key is spread evenly over 64 bits: its share of that range is its share of the buckets
    spread = F.col("_key").cast("double") / F.lit(2.0**64) + 0.5
    bucket = lambda part, n: F.least(buckets_for(n) - 1, F.floor(part * buckets_for(n)))
    rows = split_equal(rows.withColumn("_bucket", bucket(spread, F.col("_n"))), "_sid", "_bucket", "_key", "_row")
    rows = stored(running(rows, ["_sid"], "_bucket", [F.col("_key"), F.col("_source"), F.col("doc_id"), F.col("text_crc32"), F.col("_row")], {"_rank": F.lit(1)}), "shard-ranks")
    rows = rows.withColumn("_part", (F.col("_rank") + 0.5) / F.col("_n"))
    rows = rows.withColumn("_bucket", bucket(F.col("_part"), F.lit(total)))
    rows = running(rows, [], "_bucket", [F.col("_part"), F.col("_sid"), F.col("_source")], {"_at": F.lit(1)})
    rows = rows.withColumn("shard", F.expr(f"int((_at * {shards}) div {max(1, total)})"))
    # a shard's first place is the least p with p * shards div rows = shard
    return rows.select("doc_id", "size", "text_crc32", "shard", F.expr(f"_at - (shard * bigint({total}) + {shards - 1}) div {shards}").alias("slot"), *keep)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
