"""Domain views over the supplied tables: alignments, candidate edges, chains, reads, lengths, qualities, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.operators.blocks import partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target, query, s, e, rev, mapq and the columns that settle ties."""
    days = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("target"),
        F.col("l_partkey").alias("query"),
        days.alias("s"),
        (days + F.col("l_quantity").cast("long")).alias("e"),
        (F.col("l_linestatus") == "F").alias("rev"),
        F.round(F.col("l_tax") * 1000).cast("int").alias("mapq"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
    )


ALN = """aln AS (
  SELECT l_suppkey AS target, l_partkey AS query, CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS BIGINT) AS e,
    l_linestatus = 'F' AS rev, CAST(round(l_tax * 1000) AS INT) AS mapq, l_orderkey AS ord, l_linenumber AS line
  FROM lineitem)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate edges between the parts of one order: n0 < n1, is_cross and three flags; parallel edges are not yet merged."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_discount", "l_quantity")
    rows = lines.repartition(partitions(lines), "l_orderkey")
    a, b = rows.alias("a"), rows.alias("b")
    passes = (F.col("a.l_discount") >= 0.03) & (F.col("b.l_discount") >= 0.03)
    return a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_partkey") < F.col("b.l_partkey"))).select(
        F.col("a.l_partkey").alias("n0"),
        F.col("b.l_partkey").alias("n1"),
        (F.col("a.l_returnflag") != F.col("b.l_returnflag")).alias("is_cross"),
        F.lit(True).alias("is_candidate"),
        passes.alias("passes_filter"),
        (passes & (F.col("a.l_quantity") + F.col("b.l_quantity") > 50)).alias("is_selected"),
        F.lit(False).alias("is_reference"),
    )


def candidate_parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions in which the candidate edges are dealt, about a million in each."""
    return partitions(table(spark, sf_dir, "lineitem"))


CAND = """cand AS (
  SELECT a.l_partkey AS n0, b.l_partkey AS n1, a.l_returnflag <> b.l_returnflag AS is_cross, true AS is_candidate,
    a.l_discount >= 0.03 AND b.l_discount >= 0.03 AS passes_filter,
    a.l_discount >= 0.03 AND b.l_discount >= 0.03 AND a.l_quantity + b.l_quantity > 50 AS is_selected, false AS is_reference
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"""


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_size = 7").select(F.col("p_partkey").alias("name"))


EXCL = "excl AS (SELECT p_partkey AS name FROM part WHERE p_size = 7)"


def chain_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alignment as an element of its read's chain: the read is the supplier, the contig the return flag, the quality the tax."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("read"),
        F.col("l_returnflag").alias("contig"),
        F.lit(3000).cast("long").alias("contig_length"),
        F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")).cast("long").alias("s"),
        (F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) + F.col("l_quantity").cast("int")).cast("long").alias("e"),
        (F.col("l_linestatus") == "F").alias("rev"),
        F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part"),
        F.col("l_quantity").cast("long").alias("length"),
        F.col("l_tax").alias("quality"),
    )
    return rows


#: Alignments of a lower quality are no part of a chain.
CHAIN_QUALITY = 0.04
CHAIN = f"""chain AS (
  SELECT l_suppkey AS read, l_returnflag AS contig, CAST(3000 AS BIGINT) AS contig_length,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS s,
    CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS BIGINT) AS e,
    l_linestatus = 'F' AS rev, l_orderkey AS ord, l_linenumber AS line, l_partkey AS part, CAST(l_quantity AS BIGINT) AS length
  FROM lineitem WHERE l_tax >= {CHAIN_QUALITY})"""

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sequence over ACGT: its letters A-Z, mapped in turn."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("read"), F.translate(letters, *_LETTERS).alias("sequence"))


READS = f"""reads AS (
  SELECT doc_id AS read, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS[0]}', '{_LETTERS[1]}') AS sequence FROM documents)"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a sequence over ACGT, made as the reads are."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("read"), F.translate(letters, *_LETTERS).alias("sequence"))


REFERENCES = f"""refs AS (
  SELECT item_id AS read, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS[0]}', '{_LETTERS[1]}') AS sequence FROM benchmark)"""


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.col("n_chars").alias("length"))


LENS = "lens AS (SELECT doc_id, lang, source, n_chars AS length FROM documents)"


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phred scores of each read (user) by position."""
    q = (F.floor("value").cast("int") % 41).alias("q")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("read"), F.col("event_id").alias("pos"), q)


QUAL = "qual AS (SELECT user_id AS read, event_id AS pos, CAST(floor(value) AS INT) % 41 AS q FROM events)"


def phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two binary assignments of the labelled documents, by component."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("lang").alias("component"), F.col("quality").alias("a"), F.col("toxic").alias("b"))


PHASE = "phase AS (SELECT l.doc_id, d.lang AS component, l.quality AS a, l.toxic AS b FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
