"""Readers and writers of record formats: alignments, adjacency lists, sequences, SAM, phases, name and length lists.

Every reader has a fixed schema and stays a lazy DataFrame: text lines are split
and cast in the JVM. ``read_fastq`` alone counts the lines of each block when it is
called, and puts records together in Arrow batches. Values that should be there and are not make the read fail.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanloom.functions.scratch import stored
from spanloom.functions.shipping import ship_package
from spanloom.operators.edges import FLAGS, KEY

_ALIGNMENT = ["query", "query_length", "query_start", "query_stop", "strand", "target", "target_length", "target_start", "target_stop", "residue_matches", "alignment_length", "mapq"]


def _checked(rows: DataFrame, good: Column, what: str) -> DataFrame:
    """Fails, when it is run, at the first row that is not good."""
    return rows.filter(F.when(good, True).otherwise(F.raise_error(F.lit(what))))


def parse_alignments(lines: DataFrame) -> DataFrame:
    """Rows of tab-separated alignment lines (column ``value``): twelve columns and the minimizer count of a cm:i: tag, null without one."""
    parts = F.split("value", "\t")
    rows = _checked(lines.filter(F.trim("value") != ""), F.size(parts) >= 12, "an alignment line has fewer than 12 columns")
    rows = rows.select("value", parts.alias("p"))
    rows = _checked(rows, F.col("p")[4].isin("+", "-"), "an alignment's strand is neither + nor -")
    text = {"query", "strand", "target"}
    columns = [(F.col("p")[k] if n in text else F.trim(F.col("p")[k]).cast("long")).alias(n) for k, n in enumerate(_ALIGNMENT)]
    tag = F.regexp_extract("value", r"\tcm:i:(\d+)", 1)
    return rows.select(*columns, F.when(tag != "", tag.cast("long")).alias("minimizers")).withColumn("is_reverse", F.col("strand") == "-")


def read_alignments(spark: SparkSession, path: str, min_quality: int = 0) -> DataFrame:
    return parse_alignments(spark.read.text(path)).filter(F.col("mapq") >= min_quality)


def intervals(rows: DataFrame) -> DataFrame:
    """Alignments as intervals on their targets: the columns of the overlap operators."""
    return rows.select("target", "query", F.col("target_start").alias("s"), F.col("target_stop").alias("e"), F.col("is_reverse").alias("rev"), "mapq")


def chain_rows(rows: DataFrame, min_quality: int = 5, min_minimizers: int = 0) -> DataFrame:
    """Alignments as chain elements, ordered by the middle of the query: quality and minimizers must be above the bounds."""
    kept = rows.filter((F.col("mapq") > min_quality) & (F.col("minimizers") > min_minimizers))
    return kept.select(
        F.col("query").alias("read"),
        F.col("target").alias("contig"),
        F.col("target_length").alias("contig_length"),
        F.col("target_start").alias("s"),
        F.col("target_stop").alias("e"),
        F.col("is_reverse").alias("rev"),
        ((F.col("query_start") + F.col("query_stop")) / 2).alias("ord"),
        F.col("query_start").alias("line"),
        F.col("query_stop").alias("part"),
        F.col("query_length").alias("length"),
    )


def write_alignments(rows: DataFrame, path: str) -> None:
    tag = F.when(F.col("minimizers").isNotNull(), F.concat(F.lit("cm:i:"), F.col("minimizers").cast("string")))
    rows.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in _ALIGNMENT], F.when(tag.isNotNull(), F.lit("tp:A:P")), tag).alias("value")).write.text(path)


def alignment_lines(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """Whole lines whose first column is among ``names`` (column name)."""
    lines = spark.read.text(path).withColumn("name", F.substring_index("value", "\t", 1))
    return lines.join(names.select("name"), "name", "left_semi").select("value")


def read_adjacency(spark: SparkSession, path: str, header: bool = True, numeric: bool = False) -> DataFrame:
    """Labelled edges of a CSV: name_a, name_b, same strand (Yes/No), and optional Yes/No for passing the filter and being selected.

    Names are put in order, as text or, if ``numeric``, as whole numbers, and parallel edges kept; a missing flag is false.
    """
    schema = "a string, b string, same string, passes string, selected string"
    rows = spark.read.csv(path, schema=schema, header=header, enforceSchema=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = _checked(rows, F.col("b").isNotNull() & F.col("same").isNotNull(), "an adjacency line has fewer than 3 columns")
    yes = lambda c: F.coalesce(F.col(c) == "Yes", F.lit(False))
    place = lambda c: F.struct(*([F.col(c).cast("decimal(38,0)").alias("number")] if numeric else []), F.col(c).alias("name"))
    ends = [end(place("a"), place("b"))["name"].alias(n) for end, n in ((F.least, "n0"), (F.greatest, "n1"))]
    return rows.select(*ends, (F.col("same") == "No").alias("is_cross"), F.lit(True).alias("is_candidate"), yes("passes").alias("passes_filter"), yes("selected").alias("is_selected"), F.lit(False).alias("is_reference"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Labelled edges as CSV, flags as Yes and No."""
    said = lambda c: F.when(c, "Yes").otherwise("No")
    edges.select("n0", "n1", said(~F.col(KEY[2])).alias("is_same_strand"), *[said(F.col(f)).alias(f) for f in FLAGS]).write.csv(path, header=True)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name <> ''").distinct()


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.trim("value").cast("long").alias("length"))


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """The text between separators, with file, block and a number that rises along each block."""
    m = lambda c: F.col(f"_metadata.{c}").alias(c)
    return spark.read.text(path, lineSep=separator).select("value", m("file_path"), m("file_block_start"), F.monotonically_increasing_id().alias("at"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name and sequence of each record, which may go over several lines; the name ends at the first blank.

    A file that has text before its first ``>`` makes the read fail.
    """
    pieces = _pieces(spark, path, "\n>")
    head = F.regexp_replace(F.substring_index("r", "\n", 1), "\r$", "")
    body = F.when(F.instr("r", "\n") > 0, F.expr("substr(r, instr(r, '\n') + 1)")).otherwise("")
    records = pieces.select(F.regexp_replace("value", "^>", "").alias("r")).filter(F.trim("r") != "")
    records = records.select(F.trim(F.substring_index(head, " ", 1)).alias("name"), F.regexp_replace(body, r"\s", "").alias("sequence"))
    starts = pieces.filter("file_block_start = 0").groupBy("file_path").agg(F.min_by(F.ltrim("value"), "at").alias("r"))
    none = starts.filter(F.when((F.col("r") == "") | F.col("r").startswith(">"), False).otherwise(F.raise_error(F.lit("a FASTA file does not begin with >"))))
    return records.union(none.select(F.lit("").alias("name"), "r"))


def write_fasta(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).write.text(path)


def fasta_index(reads: DataFrame) -> DataFrame:
    """name and length; a name that stands twice makes the read fail."""
    rows = reads.groupBy("name").agg(F.count("*").alias("n"), F.max(F.length("sequence")).cast("long").alias("length"))
    return _checked(rows, F.col("n") == 1, "a name stands twice in the index").select("name", "length")


#: Blocks of files that are broadcast with their line counts; with more of them, lines are shuffled and sorted.
MOST_BLOCKS = 1_000_000


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with file_path and line, their number in the file from 0, in order in each task; and the table of blocks.

    Lines are counted for each block of a file, and the counts summed along the file, when
    this is called: a table with a row for each block. No line is shuffled for it.
    """
    m = lambda c: F.col(f"_metadata.{c}").alias(c)
    lines = spark.read.text(path).select("value", m("file_path"), m("file_block_start"), F.monotonically_increasing_id().alias("at"))
    key = ["file_path", "file_block_start"]
    counts = lines.groupBy(*key).agg(F.count("*").alias("lines"), F.min("at").alias("first"))
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(counts.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))), "blocks")
    few = blocks.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS
    joined = lines.join(F.broadcast(blocks) if few else blocks, key, "left")
    rows = _checked(joined, F.col("before").isNotNull(), "a file's blocks are not those that were counted")
    rows = rows.select("file_path", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "before", "lines", "value")
    return rows if few else rows.sortWithinPartitions("file_path", "line"), blocks


def _fours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each four lines of the column ``value`` become one row."""
    names, held = ["name", "sequence", "plus", "quality"], None
    for batch in batches:
        value = batch.column("value") if held is None else pa.concat_arrays([held, batch.column("value")])
        whole = len(value) // 4 * 4
        held = value.slice(whole)
        yield pa.RecordBatch.from_arrays([value.take(pa.array(np.arange(k, whole, 4))) for k in range(4)], names=names)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence and quality of four-line records.

    A line's place in its record is its number modulo four, so quality lines may hold
    anything. Records within a block of a file are put together in the task that reads it;
    only the lines of records that lie over the border of two blocks are shuffled. Blank
    lines at the end of a file are left out; a record that is cut makes the read fail.
    """
    lines, _ = numbered_lines(ship_package(spark), path)
    text = F.regexp_replace("value", "\r$", "").alias("value")
    start = F.col("line") - F.col("line") % 4
    inside = (start >= F.col("before")) & (start + 4 <= F.col("before") + F.col("lines"))
    whole = lines.filter(inside).select(text).mapInArrow(_fours, "name string, sequence string, plus string, quality string")
    at = lambda k: F.max(F.when(F.col("line") % 4 == k, F.col("value")))
    split = lines.filter(~inside).select("file_path", "line", text).groupBy("file_path", F.floor(F.col("line") / 4).alias("record"))
    split = split.agg(at(0).alias("name"), at(1).alias("sequence"), at(2).alias("plus"), at(3).alias("quality"))
    blank = F.trim(F.concat_ws("", "name", "sequence", "plus", "quality")) == ""
    rows = whole.unionByName(split.select(*whole.columns)).filter(~blank)
    good = F.col("name").startswith("@") & F.col("plus").startswith("+") & (F.length("sequence") == F.length("quality"))
    rows = _checked(rows, F.coalesce(good, F.lit(False)), "a FASTQ record is cut")
    return rows.select(F.substring_index(F.expr("substr(name, 2)"), " ", 1).alias("name"), "sequence", "quality")


def write_fastq(reads: DataFrame, path: str) -> None:
    reads.select(F.concat(F.lit("@"), "name", F.lit("\n"), "sequence", F.lit("\n+\n"), "quality").alias("value")).write.text(path)


def read_sam(spark: SparkSession, path: str, min_quality: int = 0) -> DataFrame:
    """name, flags, target, start, mapq, cigar and is_reverse; header lines are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.trim("value") != "")).select(parts.alias("p"))
    rows = rows.select(F.col("p")[0].alias("name"), F.col("p")[1].cast("int").alias("flags"), F.col("p")[2].alias("target"), F.col("p")[3].cast("long").alias("start"), F.col("p")[4].cast("int").alias("mapq"), F.col("p")[5].alias("cigar"))
    return rows.withColumn("is_reverse", F.col("flags").bitwiseAND(16) != 0).filter(F.col("mapq") >= min_quality)


def write_sam(rows: DataFrame, path: str) -> None:
    """name, flags, target, start, mapq and cigar as SAM lines without header; columns that are not there are stars."""
    columns = [F.col(c).cast("string") for c in ("name", "flags", "target", "start", "mapq", "cigar")]
    rows.select(F.concat_ws("\t", *columns, *map(F.lit, ("*", "0", "0", "*", "*"))).alias("value")).write.text(path)


def read_phases(spark: SparkSession, path: str) -> DataFrame:
    """Reads with component and phase; rows without both are dropped."""
    rows = spark.read.csv(path, schema="oriented string, name string, component int, phase int", header=True)
    return rows.filter("component is not null and phase is not null")


def read_read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The columns Id, Name and Palindromic of a summary with a header, as id, name, is_palindromic."""
    rows = spark.read.csv(path, header=True)
    rows = _checked(rows, F.col("Palindromic").isin("Yes", "No"), "Palindromic is neither Yes nor No")
    return rows.select(F.col("Id").cast("long").alias("id"), F.col("Name").alias("name"), (F.col("Palindromic") == "Yes").alias("is_palindromic"))


def _of_file_name(name: Column) -> tuple[Column, list[Column]]:
    """Whether a file name is a_b_1 (same strand) or a_b_0 (cross), with anything behind it; and a, b and is_cross."""
    token = F.split(name, "[_.]")
    good = F.coalesce(F.get(token, F.lit(2)).isin("0", "1"), F.lit(False))
    return good, [F.get(token, F.lit(0)).alias("a"), F.get(token, F.lit(1)).alias("b"), (F.get(token, F.lit(2)) == "0").alias("is_cross")]


def read_alignment_files(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate files named a_b_1 (same strand) or a_b_0 (cross): the reads, the strand, and the coordinates in columns 4 and 5."""
    rows = spark.read.csv(path, schema="kmer long, ordinal_a long, ordinal_b long, x long, y long", header=True, enforceSchema=True).withColumn("_f", F.col("_metadata.file_name"))
    good, named = _of_file_name(F.col("_f"))
    return _checked(rows, good, "a file name's strand is neither 0 nor 1").select(*named, "x", "y")


def read_alignment_file_edges(spark: SparkSession, path: str) -> DataFrame:
    """a < b and is_cross for each file of a folder of coordinate files, also for empty ones; only names are read.

    Two files for one edge make the read fail: there must be as many edges as files.
    """
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("_f"))
    good, named = _of_file_name(F.col("_f"))
    edges = _checked(files, good, "a file name's strand is neither 0 nor 1").select(*named)
    per = edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "is_cross").agg(F.count("*").alias("_n"))
    return _checked(per, F.col("_n") == 1, "there are fewer edges than alignment files").drop("_n")


def write_alignment_files(rows: DataFrame, path: str) -> None:
    """Rows (a, b, is_cross, kmer, ordinal_a, ordinal_b, x, y) as one coordinate file a_b_1.csv or a_b_0.csv for each pair and strand.

    Spark writes a folder for each file; the driver then gives each file its name.
    """
    spark = rows.sparkSession
    name = F.concat_ws("_", "a", "b", F.when(F.col("is_cross"), "0").otherwise("1")).alias("_name")
    parts = f"{path}-parts"
    rows.select(name, "kmer", "ordinal_a", "ordinal_b", "x", "y").repartition("_name").write.partitionBy("_name").csv(parts, header=True)
    paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = paths(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(paths(path))
    for found in store.globStatus(paths(f"{parts}/_name=*/part-*")):
        at = found.getPath()
        store.rename(at, paths(f"{path}/{at.getParent().getName().removeprefix('_name=')}.csv"))
    store.delete(paths(parts), True)


def read_alignment_info(spark: SparkSession, path: str) -> DataFrame:
    """Features of candidate pairs from a CSV with a header, and the label: whether the last column, the true overlap, is above 0."""
    fields = "a long, b long, min_aligned_fraction double, marker_count double, max_drift double, max_skip double, trim double, overlap double"
    return spark.read.csv(path, schema=fields, header=True, enforceSchema=True).withColumn("label", F.col("overlap") > 0)


def write_labelled(rows: DataFrame, label: Column, path: str) -> None:
    """Rows under ``label=true`` and ``label=false``."""
    rows.withColumn("label", label).write.partitionBy("label").parquet(path)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Rows with the label that their folder names."""
    rows = spark.read.parquet(path)
    return rows.withColumn("label", F.col("label").cast("string") == "true")


def write_list(values: DataFrame, path: str) -> None:
    """One value a line, from a table of one column."""
    values.select(F.col(values.columns[0]).cast("string").alias("value")).write.text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)
