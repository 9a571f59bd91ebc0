"""Queries that write the supplied tables in a record format, read them back and use them, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanloom.functions import scalars
from spanloom.functions.scratch import new_path
from spanloom.operators import chains, edges, graph, phasing, quality
from spanloom.plans.statistics import CONF, HALVES
from spanloom.sources import formats, views
from spanloom.sources.views import ALN, CAND, CHAIN, EXCL, LENS, READS


def _paf_rows(spark, sf_dir) -> DataFrame:
    r = views.alignments(spark, sf_dir)
    span = F.col("e") - F.col("s")
    return r.select(
        F.concat(F.lit("r"), F.col("query").cast("string")).alias("query"),
        F.lit(5000).cast("long").alias("query_length"),
        (F.col("line") * 10).cast("long").alias("query_start"),
        (F.col("line") * 10 + span).cast("long").alias("query_stop"),
        F.when(F.col("rev"), "-").otherwise("+").alias("strand"),
        F.concat(F.lit("t"), F.col("target").cast("string")).alias("target"),
        F.lit(20000).cast("long").alias("target_length"),
        (F.col("s") + 2000).alias("target_start"),
        (F.col("e") + 2000).alias("target_stop"),
        span.alias("residue_matches"),
        (span + F.col("line")).cast("long").alias("alignment_length"),
        F.col("mapq").cast("long").alias("mapq"),
        F.when(F.col("ord") % 3 != 0, F.col("ord") % 50).cast("long").alias("minimizers"),
        F.col("rev").alias("is_reverse"),
    )


def _paf(spark, sf_dir) -> str:
    path = new_path(spark, "alignments")
    formats.write_alignments(_paf_rows(spark, sf_dir), path)
    return path


PAF = f"""{ALN}, paf AS (
  SELECT 'r' || query AS query, CAST(5000 AS BIGINT) AS query_length, CAST(line * 10 AS BIGINT) AS query_start, CAST(line * 10 + e - s AS BIGINT) AS query_stop,
    CASE WHEN rev THEN '-' ELSE '+' END AS strand, 't' || target AS target, CAST(20000 AS BIGINT) AS target_length, s + 2000 AS target_start, e + 2000 AS target_stop,
    e - s AS residue_matches, CAST(e - s + line AS BIGINT) AS alignment_length, CAST(mapq AS BIGINT) AS mapq, CASE WHEN ord % 3 <> 0 THEN CAST(ord % 50 AS BIGINT) END AS minimizers, rev AS is_reverse
  FROM aln)"""


def paf_records(spark, sf_dir):
    return formats.read_alignments(spark, _paf(spark, sf_dir))


def paf_intervals(spark, sf_dir):
    return formats.intervals(formats.read_alignments(spark, _paf(spark, sf_dir), 50))


def paf_chain_rows(spark, sf_dir):
    return formats.chain_rows(formats.read_alignments(spark, _paf(spark, sf_dir)))


def paf_lines_by_name(spark, sf_dir):
    """Lines of the excluded reads, written and read again."""
    names = views.excluded(spark, sf_dir).select(F.concat(F.lit("r"), F.col("name").cast("string")).alias("name"))
    path = new_path(spark, "lines")
    formats.alignment_lines(spark, _paf(spark, sf_dir), names).write.text(path)
    return spark.read.text(path)


def name_list(spark, sf_dir):
    path = new_path(spark, "names")
    formats.write_list(views.lengths(spark, sf_dir).select("source"), path)
    return formats.read_names(spark, path)


def length_list(spark, sf_dir):
    path = new_path(spark, "lengths")
    formats.write_list(views.lengths(spark, sf_dir).select("length"), path)
    return formats.read_lengths(spark, path).groupBy("length").agg(F.count("*").alias("n"))


def _merged(spark, sf_dir) -> DataFrame:
    return edges.merge(views.candidates(spark, sf_dir), parts=views.candidate_parts(spark, sf_dir))


def edges_csv(spark, sf_dir):
    path = new_path(spark, "edges")
    formats.write_edges(_merged(spark, sf_dir), path)
    return spark.read.csv(path, header=True)


def adjacency_csv(spark, sf_dir):
    """Candidates written with the names in reverse order, and read as adjacency."""
    said = lambda c: F.when(F.col(c), "Yes").otherwise("No").alias(c)
    rows = views.candidates(spark, sf_dir).select((F.col("n1") + 100_000).alias("a"), (F.col("n0") + 100_000).alias("b"), F.when(F.col("is_cross"), "No").otherwise("Yes").alias("same"), said("passes_filter"), said("is_selected"))
    path = new_path(spark, "adjacency")
    formats.write_csv(rows, path)
    return formats.read_adjacency(spark, path, numeric=True)


def _fasta(spark, sf_dir) -> str:
    rows = views.reads(spark, sf_dir).select(F.concat(F.lit("read"), F.col("read").cast("string"), F.lit(" of a document")).alias("name"), F.regexp_replace("sequence", "(.{80})", "$1\n").alias("sequence"))
    path = new_path(spark, "fasta")
    formats.write_fasta(rows, path)
    return path


def fasta_records(spark, sf_dir):
    rows = formats.read_fasta(spark, _fasta(spark, sf_dir))
    return rows.select("name", F.md5("sequence").alias("digest"), F.length("sequence").cast("long").alias("size"))


def fasta_lengths(spark, sf_dir):
    return formats.fasta_index(formats.read_fasta(spark, _fasta(spark, sf_dir)))


def _fastq(spark, sf_dir) -> DataFrame:
    """Reads whose quality begins with @ where the sequence begins with A."""
    rows = views.reads(spark, sf_dir).filter("length(sequence) > 0")
    path = new_path(spark, "fastq")
    formats.write_fastq(rows.select(F.concat(F.lit("read"), F.col("read").cast("string")).alias("name"), "sequence", F.translate("sequence", "ACGT", "@I!5").alias("quality")), path)
    return formats.read_fastq(spark, path)


def fastq_records(spark, sf_dir):
    return _fastq(spark, sf_dir).select("name", F.md5("sequence").alias("digest"), F.md5("quality").alias("quality_digest"))


def fastq_extract(spark, sf_dir):
    """Records of the named reads with 1000 letters or more, written and read again."""
    names = views.lengths(spark, sf_dir).filter("lang = 'en'").select(F.concat(F.lit("read"), F.col("doc_id").cast("string")).alias("name"))
    rows = _fastq(spark, sf_dir).filter(F.length("sequence") >= 1000).join(names, "name", "left_semi")
    path = new_path(spark, "extract")
    formats.write_fastq(rows, path)
    return formats.read_fastq(spark, path).select("name", F.md5("sequence").alias("digest"))


def fastq_undegraded(spark, sf_dir):
    """Reads without a degraded second half, as FASTQ of their qualities, read again."""
    q = views.qualities(spark, sf_dir)
    good = quality.halves(q).filter("not is_degraded").select("read")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "q"))), lambda x: F.char(x["q"] + 33)), "")
    rows = q.join(good, "read").groupBy("read").agg(text.alias("quality")).select(F.col("read").cast("string").alias("name"), F.repeat(F.lit("N"), F.length("quality")).alias("sequence"), "quality")
    path = new_path(spark, "undegraded")
    formats.write_fastq(rows, path)
    return formats.read_fastq(spark, path).select("name", F.md5("quality").alias("digest"))


def sam_records(spark, sf_dir):
    rows = views.alignments(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("query").cast("string")).alias("name"),
        F.when(F.col("rev"), 16).otherwise(0).alias("flags"),
        F.concat(F.lit("t"), F.col("target").cast("string")).alias("target"),
        (F.col("s") + 2000).alias("start"),
        "mapq",
        F.concat((F.col("e") - F.col("s")).cast("string"), F.lit("M")).alias("cigar"),
    )
    path = new_path(spark, "sam")
    formats.write_sam(rows, path)
    return formats.read_sam(spark, path, 20)


def phases_csv(spark, sf_dir):
    """Phases of the labelled documents; toxic ones are written without component and phase, and dropped when read."""
    rows = views.table(spark, sf_dir, "labels")
    known = F.col("toxic") == 0
    path = new_path(spark, "phases")
    formats.write_csv(rows.select(F.concat("doc_id", F.lit("-0")).alias("OrientedReadId"), F.col("doc_id").alias("ReadName"), F.when(known, F.col("doc_id") % 7).alias("Component"), F.when(known, F.col("quality")).alias("Phase")), path)
    return formats.read_phases(spark, path)


def read_summary_csv(spark, sf_dir):
    rows = views.lengths(spark, sf_dir)
    path = new_path(spark, "summary")
    formats.write_csv(rows.select(F.col("doc_id").alias("Id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("Name"), F.col("length").alias("RawReadLength"), F.when(F.col("length") % 2 == 0, "Yes").otherwise("No").alias("Palindromic")), path)
    return formats.read_read_summary(spark, path)


def labelled_folders(spark, sf_dir):
    """Candidate edges dealt over folders by their filter flag, and read with the folder as the label."""
    path = new_path(spark, "labelled")
    formats.write_labelled(views.candidates(spark, sf_dir).select("n0", "n1", "is_cross", "passes_filter"), F.col("passes_filter"), path)
    return formats.read_labelled(spark, path).groupBy("label", "is_cross").agg(F.count("*").alias("n"), F.sum(F.col("n0") * 3 + F.col("n1")).alias("total"), F.bool_and("passes_filter").alias("passes_filter"))


def alignment_info(spark, sf_dir):
    """Features of each order line's pair of part and supplier, written as CSV and read with their label."""
    rows = views.table(spark, sf_dir, "lineitem")
    days = F.pmod(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")), F.lit(30))
    path = new_path(spark, "info")
    formats.write_csv(rows.select("l_partkey", "l_suppkey", "l_discount", "l_quantity", days.alias("drift"), F.col("l_linenumber").alias("skip"), "l_tax", F.greatest(days - 10, F.lit(0)).alias("overlap")), path)
    return formats.read_alignment_info(spark, path).groupBy("label", "max_skip").agg(F.count("*").alias("n"), F.sum("marker_count").alias("markers"), F.round(F.avg("trim"), 6).alias("trim"))


def chimera_files(spark, sf_dir):
    path = new_path(spark, "chimeras")
    chains.chimera_files(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY)).write.partitionBy("kind").text(path)
    return spark.read.text(path, recursiveFileLookup=False)


def chimera_stats(spark, sf_dir):
    per = chains.chimeric(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY)).withColumn("name", F.concat(F.lit("set"), (F.col("read") % 5).cast("string")))
    path = new_path(spark, "stats")
    formats.write_csv(chains.chimera_stats(per, "name"), path)
    return spark.read.csv(path, schema="name string, n50 long, n_chimeric long, n_others long", header=True)


def _names(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "part").filter("p_size <> 7").select(F.col("p_partkey").alias("id"), F.concat_ws("/", F.col("p_brand"), F.col("p_partkey").cast("string")).alias("name"))


def renamed_overlaps(spark, sf_dir):
    """Candidate edges with the names of their parts, written and read again."""
    path = new_path(spark, "renamed")
    formats.write_csv(edges.renamed(_merged(spark, sf_dir), _names(spark, sf_dir), views.candidate_parts(spark, sf_dir)).select("a", "b", "is_cross"), path)
    return spark.read.csv(path, header=True, schema="a string, b string, is_cross boolean")


def first_by_name(spark, sf_dir):
    """The first part of each brand but those that begin with Brand#1."""
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"))
    return edges.first_by_name(parts, parts.filter("name not like 'Brand#1%'").select("name"))


def edge_lookup(spark, sf_dir):
    """The labelled edges of pairs that are asked for in reverse order; half of these have no edge of that strand."""
    e = _merged(spark, sf_dir)
    return edges.find(e, e.select(F.col("n1").alias("a"), F.col("n0").alias("b"), F.lit(True).alias("is_cross")), views.candidate_parts(spark, sf_dir))


def edges_of_nodes(spark, sf_dir):
    return edges.restrict(_merged(spark, sf_dir), _names(spark, sf_dir).filter("id % 3 <> 0").select(F.col("id").alias("name")))


def selected_edges(spark, sf_dir):
    return edges.only(_merged(spark, sf_dir), "is_selected").select("n0", "n1", "is_cross")


def node_labels(spark, sf_dir):
    """Labels of both strands, written and read again, with the name that is left without the strand."""
    names = edges.nodes(views.candidates(spark, sf_dir))
    path = new_path(spark, "labels")
    formats.write_csv(graph.labels(names), path)
    return spark.read.csv(path, header=True, schema="node long, label string").withColumn("name", scalars.without_strand(F.col("label")))


def _alignment_folder(spark, sf_dir) -> str:
    """The order lines as coordinates of alignments between a line number and a return flag, on the strand of their status."""
    path = new_path(spark, "alignment-files")
    rows = views.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("a"),
        F.col("l_returnflag").alias("b"),
        (F.col("l_linestatus") == "F").alias("is_cross"),
        F.col("l_orderkey").cast("long").alias("kmer"),
        F.col("l_linenumber").cast("long").alias("ordinal_a"),
        F.col("l_linenumber").cast("long").alias("ordinal_b"),
        F.col("l_partkey").cast("long").alias("x"),
        F.col("l_suppkey").cast("long").alias("y"),
    )
    formats.write_alignment_files(rows, path)
    return path


def alignment_file_rows(spark, sf_dir):
    """Coordinates of each file of a folder: their number and sums."""
    rows = formats.read_alignment_files(spark, _alignment_folder(spark, sf_dir))
    return rows.groupBy("a", "b", "is_cross").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"), F.sum("y").alias("y_sum"))


def alignment_file_edges(spark, sf_dir):
    """The edges that a folder's files stand for."""
    return formats.read_alignment_file_edges(spark, _alignment_folder(spark, sf_dir))


_FOLDER = "f AS (SELECT 'n' || l_linenumber AS a, l_returnflag AS b, l_linestatus = 'F' AS is_cross, CAST(l_partkey AS BIGINT) AS x, CAST(l_suppkey AS BIGINT) AS y FROM lineitem)"


def discordant_csv(spark, sf_dir):
    rows = phasing.refuse_conflicts(views.phases(spark, sf_dir), "doc_id")
    path = new_path(spark, "discordant")
    formats.write_csv(phasing.discordant(rows, phasing.confusion(rows)), path)
    return spark.read.csv(path, header=True, schema="doc_id long, component string, a int, b int")


MERGED = f"WITH {CAND}, m AS (SELECT n0, n1, is_cross, bool_or(is_candidate) AS is_candidate, bool_or(passes_filter) AS passes_filter, bool_or(is_selected) AS is_selected, bool_or(is_reference) AS is_reference FROM cand GROUP BY n0, n1, is_cross)"
_YES = "CASE WHEN {0} THEN 'Yes' ELSE 'No' END AS {0}"
FASTQ = f"WITH {READS}, q AS (SELECT 'read' || read AS name, read, sequence, translate(sequence, 'ACGT', '@I!5') AS quality FROM reads WHERE length(sequence) > 0)"
W = "(PARTITION BY read ORDER BY ord, line, part, s, e, contig, rev)"
ISLANDS = f"""WITH {CHAIN}, f AS (
  SELECT *, CASE WHEN rev THEN e ELSE s END AS f0, CASE WHEN rev THEN s ELSE e END AS f1, CASE WHEN rev THEN s ELSE contig_length - e END AS to_end FROM chain),
p AS (SELECT *, row_number() OVER {W} - 1 AS place, lag(contig) OVER {W} AS pc, lag(f0) OVER {W} AS p0, lag(f1) OVER {W} AS p1, lag(to_end) OVER {W} AS pe FROM f),
gaps AS (SELECT *, CASE WHEN pc IS NULL THEN NULL WHEN pc <> contig THEN pe + to_end + {chains.PENALTY} WHEN p1 > f0 AND p0 < f1 THEN 0 ELSE abs(p1 - f0) END AS gap FROM p),
islands AS (SELECT *, CAST(sum(CASE WHEN gap > {chains.MAX_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY read ORDER BY place) AS BIGINT) AS island FROM gaps),
part AS (SELECT read, island, arg_min(s, place) AS start, arg_max(e, place) AS stop, sum(length) AS bases FROM islands GROUP BY read, island),
r AS (SELECT read, count(*) AS n, CAST(sum(bases) AS BIGINT) AS bases, string_agg('(' || start || ',' || stop || ')', ',' ORDER BY island) AS bounds FROM part GROUP BY read)"""

QUERIES = {
    k: globals()[k]
    for k in (
        "alignment_file_rows alignment_file_edges paf_records paf_intervals paf_chain_rows paf_lines_by_name name_list length_list edges_csv adjacency_csv fasta_records fasta_lengths fastq_records fastq_extract fastq_undegraded "
        "sam_records phases_csv read_summary_csv labelled_folders alignment_info chimera_files chimera_stats renamed_overlaps first_by_name edge_lookup edges_of_nodes selected_edges node_labels discordant_csv"
    ).split()
}
_LINE = "concat_ws(chr(9), query, query_length, query_start, query_stop, strand, target, target_length, target_start, target_stop, residue_matches, alignment_length, mapq, CASE WHEN minimizers IS NOT NULL THEN 'tp:A:P' || chr(9) || 'cm:i:' || minimizers END)"
ORACLE = {
    "paf_records": f"WITH {PAF} SELECT * FROM paf",
    "paf_intervals": f"WITH {PAF} SELECT target, query, target_start AS s, target_stop AS e, is_reverse AS rev, mapq FROM paf WHERE mapq >= 50",
    "paf_chain_rows": f"""WITH {PAF} SELECT query AS read, target AS contig, target_length AS contig_length, target_start AS s, target_stop AS e, is_reverse AS rev,
  (query_start + query_stop) / 2 AS ord, query_start AS line, query_stop AS part, query_length AS length FROM paf WHERE mapq > 5 AND minimizers > 0""",
    "paf_lines_by_name": f"WITH {PAF}, {EXCL} SELECT {_LINE} AS value FROM paf WHERE query IN (SELECT 'r' || name FROM excl)",
    "name_list": f"WITH {LENS} SELECT DISTINCT source AS name FROM lens",
    "length_list": f"WITH {LENS} SELECT length, count(*) AS n FROM lens GROUP BY length",
    "edges_csv": f"{MERGED} SELECT CAST(n0 AS VARCHAR) AS n0, CAST(n1 AS VARCHAR) AS n1, CASE WHEN is_cross THEN 'No' ELSE 'Yes' END AS is_same_strand, {', '.join(_YES.format(f) for f in edges.FLAGS)} FROM m",
    "adjacency_csv": f"WITH {CAND} SELECT CAST(n0 + 100000 AS VARCHAR) AS n0, CAST(n1 + 100000 AS VARCHAR) AS n1, is_cross, is_candidate, passes_filter, is_selected, is_reference FROM cand",
    "fasta_records": f"WITH {READS} SELECT 'read' || read AS name, md5(sequence) AS digest, length(sequence) AS size FROM reads",
    "fasta_lengths": f"WITH {READS} SELECT 'read' || read AS name, length(sequence) AS length FROM reads",
    "alignment_file_rows": f"WITH {_FOLDER} SELECT a, b, is_cross, count(*) AS n, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum FROM f GROUP BY ALL",
    "alignment_file_edges": f"WITH {_FOLDER} SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, is_cross FROM f",
    "fastq_records": f"{FASTQ} SELECT name, md5(sequence) AS digest, md5(quality) AS quality_digest FROM q",
    "fastq_extract": f"{FASTQ} SELECT name, md5(sequence) AS digest FROM q WHERE length(sequence) >= 1000 AND read IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "fastq_undegraded": f"WITH h AS ({HALVES}) SELECT CAST(q.read AS VARCHAR) AS name, md5(string_agg(chr(q.q + 33), '' ORDER BY q.pos)) AS digest FROM ({{qual}}) q JOIN h ON h.read = q.read WHERE NOT h.is_degraded GROUP BY q.read".replace("{qual}", "SELECT user_id AS read, event_id AS pos, CAST(floor(value) AS INT) % 41 AS q FROM events"),
    "sam_records": f"WITH {ALN} SELECT 'r' || query AS name, CASE WHEN rev THEN 16 ELSE 0 END AS flags, 't' || target AS target, s + 2000 AS start, mapq, (e - s) || 'M' AS cigar, rev AS is_reverse FROM aln WHERE mapq >= 20",
    "phases_csv": "SELECT doc_id || '-0' AS oriented, CAST(doc_id AS VARCHAR) AS name, CAST(doc_id % 7 AS INT) AS component, quality AS phase FROM labels WHERE toxic = 0",
    "read_summary_csv": f"WITH {LENS} SELECT doc_id AS id, source || '/' || doc_id AS name, length % 2 = 0 AS is_palindromic FROM lens",
    "labelled_folders": f"WITH {CAND} SELECT passes_filter AS label, is_cross, count(*) AS n, CAST(sum(n0 * 3 + n1) AS BIGINT) AS total, passes_filter FROM cand GROUP BY passes_filter, is_cross",
    "alignment_info": """SELECT ((date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) % 30) + 30) % 30 > 10 AS label, CAST(l_linenumber AS DOUBLE) AS max_skip, count(*) AS n, sum(l_quantity) AS markers, round(avg(l_tax), 6) AS trim FROM lineitem GROUP BY 1, 2""",
    "chimera_files": f"""{ISLANDS} SELECT CASE WHEN n > 1 THEN 'chimeric_reads' ELSE 'other_reads' END AS kind, CAST(read AS VARCHAR) AS value FROM r
UNION ALL SELECT CASE WHEN n > 1 THEN 'chimeric_lengths' ELSE 'other_lengths' END, CAST(bases AS VARCHAR) FROM r
UNION ALL SELECT 'subchains', read || chr(9) || bounds FROM r WHERE n > 1
UNION ALL SELECT 'subchain_lengths', CAST(abs(e - s) AS VARCHAR) FROM islands WHERE read IN (SELECT read FROM r WHERE n > 1)""",
    "chimera_stats": f"""{ISLANDS}, g AS (SELECT 'set' || (read % 5) AS name, n > 1 AS chimeric, bases, sum(bases) OVER (PARTITION BY read % 5 ORDER BY bases) AS upto, sum(bases) OVER (PARTITION BY read % 5) AS whole FROM r)
SELECT name, min(bases) FILTER (WHERE 2 * upto >= whole) AS n50, count(*) FILTER (WHERE chimeric) AS n_chimeric, count(*) FILTER (WHERE NOT chimeric) AS n_others FROM g GROUP BY name""",
    "renamed_overlaps": f"{MERGED}, named AS (SELECT p_partkey AS id, p_brand || '/' || p_partkey AS name FROM part WHERE p_size <> 7) SELECT x.name AS a, y.name AS b, is_cross FROM m JOIN named x ON x.id = n0 JOIN named y ON y.id = n1",
    "first_by_name": "SELECT p_brand AS name, min(p_partkey) AS id FROM part WHERE p_brand NOT LIKE 'Brand#1%' GROUP BY p_brand",
    "edge_lookup": f"{MERGED} SELECT n1 AS a, n0 AS b, n0, n1, is_cross, is_candidate, passes_filter, is_selected, is_reference FROM m WHERE is_cross",
    "edges_of_nodes": f"{MERGED}, k AS (SELECT p_partkey AS name FROM part WHERE p_size <> 7 AND p_partkey % 3 <> 0) SELECT * FROM m WHERE n0 IN (SELECT name FROM k) AND n1 IN (SELECT name FROM k)",
    "selected_edges": f"{MERGED} SELECT n0, n1, is_cross FROM m WHERE is_selected",
    "node_labels": f"WITH {CAND}, k AS (SELECT n0 AS name FROM cand UNION SELECT n1 FROM cand) SELECT 2 * name + i AS node, name || CASE WHEN i = 0 THEN '+' ELSE '-' END AS label, CAST(name AS VARCHAR) AS name FROM k, (VALUES (0), (1)) x(i)",
    "discordant_csv": f"{CONF} SELECT p.doc_id, p.component, p.a, p.b FROM phase p JOIN m ON p.component = m.component WHERE (p.a = p.b) <> (n00 + n11 >= n01 + n10)",
}
