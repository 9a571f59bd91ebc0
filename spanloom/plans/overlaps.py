"""Queries on alignments, edges, graphs and chains, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions.scratch import stored
from spanloom.functions.shipping import ship_package
from spanloom.operators import boxes, chains, edges, graph, intervals
from spanloom.sources import views
from spanloom.sources.views import ALN, CAND, CHAIN, EXCL
from spanloom.streaming.chains import replayed

EDGES = """SELECT DISTINCT a.query AS n0, b.query AS n1, a.rev <> b.rev AS is_cross
  FROM aln a JOIN aln b ON a.target = b.target AND a.s < b.e AND b.s < a.e AND a.query < b.query
  WHERE a.mapq >= {q} AND b.mapq >= {q} AND a.s < a.e AND b.s < b.e"""


def overlap_edges(spark, sf_dir):
    return intervals.overlap_edges(views.alignments(spark, sf_dir), 50)


def overlap_edges_by_target(spark, sf_dir):
    return intervals.overlap_edges(views.alignments(spark, sf_dir), 50, width=None)


def _labeled(spark, sf_dir):
    parts = views.candidate_parts(spark, sf_dir)
    candidates = edges.merge(views.candidates(spark, sf_dir), parts=parts)
    known = edges.nodes(candidates).withColumnRenamed("name", "query")
    aln = views.alignments(spark, sf_dir).filter("mapq >= 60").join(known, "query", "left_semi")
    return edges.exclude(edges.merge(candidates, edges.reference(intervals.overlap_edges(aln, 60)), parts=parts), views.excluded(spark, sf_dir))


LABELED = f"""WITH {ALN}, {CAND}, {EXCL}, known AS (SELECT n0 AS name FROM cand UNION SELECT n1 FROM cand),
ref AS (
  SELECT DISTINCT a.query AS n0, b.query AS n1, a.rev <> b.rev AS is_cross
  FROM aln a JOIN aln b ON a.target = b.target AND a.s < b.e AND b.s < a.e AND a.query < b.query
  WHERE a.mapq >= 60 AND b.mapq >= 60 AND a.s < a.e AND b.s < b.e AND a.query IN (SELECT name FROM known) AND b.query IN (SELECT name FROM known)
), labeled AS (
  SELECT n0, n1, is_cross, bool_or(is_candidate) AS is_candidate, bool_or(passes_filter) AS passes_filter, bool_or(is_selected) AS is_selected, bool_or(is_reference) AS is_reference
  FROM (SELECT * FROM cand UNION ALL SELECT n0, n1, is_cross, false, false, false, true FROM ref)
  WHERE n0 NOT IN (SELECT name FROM excl) AND n1 NOT IN (SELECT name FROM excl)
  GROUP BY n0, n1, is_cross)"""


def edge_accuracy(spark, sf_dir):
    return edges.accuracy(_labeled(spark, sf_dir))


def _level(f):
    return f"""SELECT '{f}' AS level, count(*) FILTER (WHERE {f} AND is_reference) AS tp, count(*) FILTER (WHERE {f} AND NOT is_reference) AS fp, count(*) FILTER (WHERE NOT {f} AND is_reference) AS fn FROM labeled"""


ACCURACY = f"""{LABELED}, counts AS ({' UNION ALL '.join(map(_level, edges.FLAGS[:3]))})
SELECT level, tp, fp, fn, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS sensitivity FROM counts"""


def edge_render_class(spark, sf_dir):
    return _labeled(spark, sf_dir).select(*edges.KEY, edges.colour().alias("colour"), edges.depth().alias("depth"))


RENDER = f"""{LABELED} SELECT n0, n1, is_cross,
  CASE WHEN is_selected THEN CASE WHEN is_reference THEN '#00C442' ELSE '#FF2800' END
    WHEN passes_filter THEN CASE WHEN is_reference THEN '#0658C2' ELSE '#FF9E00' END
    WHEN is_candidate THEN CASE WHEN is_reference THEN '#450BBA' ELSE '#FFDD00' END
    WHEN is_reference THEN '#C50094' END AS colour,
  CASE WHEN NOT is_reference THEN 0 WHEN is_selected THEN 3 WHEN passes_filter THEN 2 WHEN is_candidate THEN 1 ELSE 4 END AS depth
FROM labeled"""


def coverage_segments(spark, sf_dir):
    return intervals.coverage_segments(views.alignments(spark, sf_dir), 60)


COVERAGE = f"""WITH {ALN}, r AS (SELECT target, s, e, 2 * query + CAST(rev AS BIGINT) AS id FROM aln WHERE mapq >= 60 AND s < e),
cuts AS (SELECT target, s AS cut FROM r UNION SELECT target, e FROM r),
seg AS (SELECT target, cut, lead(cut) OVER (PARTITION BY target ORDER BY cut) AS stop FROM cuts),
sets AS (
  SELECT seg.target, seg.cut, seg.stop, count(*) AS n_ids, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT seg.target, seg.cut, seg.stop, r.id FROM seg JOIN r ON r.target = seg.target AND r.s <= seg.cut AND seg.cut < r.e WHERE seg.stop IS NOT NULL) seg
  GROUP BY ALL),
marked AS (SELECT *, CASE WHEN lag(stop) OVER w = cut AND lag(ids) OVER w = ids THEN 0 ELSE 1 END AS new FROM sets WINDOW w AS (PARTITION BY target ORDER BY cut)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY target ORDER BY cut) AS island FROM marked)
SELECT target, min(cut) AS seg_start, max(stop) AS seg_stop, min(n_ids) AS n_ids, min(ids) AS ids FROM islands GROUP BY target, island"""

def double_stranded_edges(spark, sf_dir):
    return graph.double_stranded(intervals.overlap_edges(views.alignments(spark, sf_dir), 70))


STRANDED = f"""WITH {ALN}, edge AS ({EDGES.format(q=70)}),
ds AS (
  SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v FROM (
    SELECT 2 * n0 AS u, 2 * n1 + CAST(is_cross AS BIGINT) AS v FROM edge UNION ALL
    SELECT 2 * n0 + 1, 2 * n1 + 1 - CAST(is_cross AS BIGINT) FROM edge))"""


def subgraph_radius(spark, sf_dir):
    """Radius 2 around both strands of the read with the least id of the smallest-target alignments."""
    stranded = stored(double_stranded_edges(spark, sf_dir), "stranded")
    first = stranded.agg(F.min(F.floor(F.col("u") / 2)).alias("n")).first()["n"]
    return graph.subgraph(stranded, [2 * first, 2 * first + 1] if first is not None else [], 2)


SUBGRAPH = f"""{STRANDED}, d0 AS (SELECT DISTINCT 2 * (SELECT min(u // 2) FROM ds) + k AS node FROM (VALUES (0), (1)) x(k)),
d1 AS (SELECT node FROM d0 UNION SELECT v FROM ds WHERE u IN (SELECT node FROM d0) UNION SELECT u FROM ds WHERE v IN (SELECT node FROM d0))
SELECT u, v FROM ds WHERE u IN (SELECT node FROM d1) OR v IN (SELECT node FROM d1)"""


def node_distances(spark, sf_dir):
    """Steps from both strands of the read with the least id to every node that can be reached."""
    stranded = stored(double_stranded_edges(spark, sf_dir), "stranded")
    first = stranded.agg(F.min(F.floor(F.col("u") / 2)).alias("n")).first()["n"]
    return graph.distances(stranded, [2 * first, 2 * first + 1] if first is not None else [])


DISTANCES = f"""WITH RECURSIVE {STRANDED[5:]}, near AS (SELECT u, v FROM ds UNION SELECT v, u FROM ds),
r(node, distance) USING KEY (node) AS (
  SELECT 2 * (SELECT min(u // 2) FROM ds) + k, CAST(0 AS BIGINT) FROM (VALUES (0), (1)) x(k)
  UNION
  SELECT near.v, min(r.distance) + 1 FROM r JOIN near ON near.u = r.node LEFT JOIN recurring.r AS old ON old.node = near.v WHERE old.node IS NULL GROUP BY near.v)
SELECT node, distance FROM r"""


def chain_gaps(spark, sf_dir):
    return chains.gaps(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY)).select("read", "place", "contig", "s", "e", "rev", "gap")


W = "(PARTITION BY read ORDER BY ord, line, part, s, e, contig, rev)"
GAPS = f"""WITH {CHAIN}, f AS (
  SELECT *, CASE WHEN rev THEN e ELSE s END AS f0, CASE WHEN rev THEN s ELSE e END AS f1, CASE WHEN rev THEN s ELSE contig_length - e END AS to_end FROM chain),
p AS (
  SELECT *, row_number() OVER {W} - 1 AS place, lag(contig) OVER {W} AS pc, lag(f0) OVER {W} AS p0, lag(f1) OVER {W} AS p1, lag(to_end) OVER {W} AS pe FROM f),
gaps AS (
  SELECT *, CASE WHEN pc IS NULL THEN NULL WHEN pc <> contig THEN pe + to_end + {chains.PENALTY} WHEN p1 > f0 AND p0 < f1 THEN 0 ELSE abs(p1 - f0) END AS gap FROM p),
islands AS (SELECT *, CAST(sum(CASE WHEN gap > {chains.MAX_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY read ORDER BY place) AS BIGINT) AS island FROM gaps)"""


def chain_islands(spark, sf_dir):
    return chains.islands(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY)).select("read", "place", "island")


def chain_islands_streamed(spark, sf_dir):
    """The same from a stream: elements arrive in their order, and each is placed when it comes."""
    elements = chains.of_quality(views.chain_elements(ship_package(spark), sf_dir), views.CHAIN_QUALITY)
    return replayed(elements).filter("kind = 'element'").select("read", "place", "gap", "island")


def chimeric_reads(spark, sf_dir):
    return chains.chimeric(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY))


def subchain_bounds(spark, sf_dir):
    return chains.subchain_bounds(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY))


def strand_flips(spark, sf_dir):
    return chains.strand_flips(chains.of_quality(views.chain_elements(spark, sf_dir), views.CHAIN_QUALITY))


def best_alignment_per_query(spark, sf_dir):
    rows = chains.best_by(views.alignments(spark, sf_dir), ["query"], [(F.col("e") - F.col("s")).desc(), F.desc("mapq"), "target", "s", "ord", "line", "rev"])
    return rows.select("query", "target", "s", "e", "rev", "mapq")


def alignments_by_name(spark, sf_dir):
    names = views.excluded(spark, sf_dir).withColumnRenamed("name", "query")
    return views.alignments(spark, sf_dir).filter("mapq >= 50").join(names, "query", "left_semi").select("query", "target", "s", "e", "rev", "mapq", "ord", "line")


def box_pairs(spark, sf_dir):
    """Alignments of one target as boxes in the plane of place and order: pairs that intersect in both."""
    rows = views.alignments(spark, sf_dir).filter("s < e").withColumn("y", F.col("ord") % 512)
    rows = rows.select("target", "query", "ord", "line", F.col("s").alias("x0"), F.col("e").alias("x1"), F.col("y").alias("y0"), (F.col("y") + 32).alias("y1"))
    pairs = boxes.intersecting(rows, ["target"], ["query", "ord", "line"], 64)
    return pairs.groupBy(F.col("a.target").alias("target")).agg(F.count("*").alias("n_pairs"))


BOXES = f"""WITH {ALN}, r AS (SELECT *, ord % 512 AS y FROM aln WHERE s < e)
SELECT a.target, count(*) AS n_pairs FROM r a JOIN r b ON a.target = b.target AND a.s < b.e AND b.s < a.e AND abs(a.y - b.y) < 32
  AND (a.query, a.ord, a.line) < (b.query, b.ord, b.line) GROUP BY a.target"""

QUERIES = {
    "overlap_edges": overlap_edges,
    "overlap_edges_by_target": overlap_edges_by_target,
    "labeled_edges": _labeled,
    "edge_accuracy": edge_accuracy,
    "edge_render_class": edge_render_class,
    "coverage_segments": coverage_segments,
    "double_stranded_edges": double_stranded_edges,
    "subgraph_radius": subgraph_radius,
    "node_distances": node_distances,
    "chain_gaps": chain_gaps,
    "chain_islands": chain_islands,
    "chain_islands_streamed": chain_islands_streamed,
    "chimeric_reads": chimeric_reads,
    "subchain_bounds": subchain_bounds,
    "strand_flips": strand_flips,
    "best_alignment_per_query": best_alignment_per_query,
    "alignments_by_name": alignments_by_name,
    "box_pairs": box_pairs,
}
_EDGE_SQL = f"WITH {ALN} {EDGES.format(q=50)}"
ORACLE = {
    "overlap_edges": _EDGE_SQL,
    "overlap_edges_by_target": _EDGE_SQL,
    "labeled_edges": f"{LABELED} SELECT * FROM labeled",
    "edge_accuracy": ACCURACY,
    "edge_render_class": RENDER,
    "coverage_segments": COVERAGE,
    "double_stranded_edges": f"{STRANDED} SELECT * FROM ds",
    "subgraph_radius": SUBGRAPH,
    "node_distances": DISTANCES,
    "chain_gaps": f"{GAPS} SELECT read, place, contig, s, e, rev, gap FROM gaps",
    "chain_islands": f"{GAPS} SELECT read, place, island FROM islands",
    "chain_islands_streamed": f"{GAPS} SELECT read, place, gap, island FROM islands",
    "chimeric_reads": f"{GAPS} SELECT read, count(*) AS n_elements, max(island) + 1 AS n_islands, CAST(sum(length) AS BIGINT) AS bases, max(island) > 0 AS is_chimeric FROM islands GROUP BY read",
    "subchain_bounds": f"""{GAPS} SELECT read, island, min(place) AS first_place, max(place) AS last_place, arg_min(s, place) AS start, arg_max(e, place) AS stop,
  count(*) AS n_elements, CAST(sum(length) AS BIGINT) AS bases FROM islands GROUP BY read, island""",
    "strand_flips": f"WITH {CHAIN}, p AS (SELECT *, lag(rev) OVER {W} <> rev AS flip FROM chain) SELECT read, count(DISTINCT contig) AS n_contigs, CAST(sum(CASE WHEN flip THEN 1 ELSE 0 END) AS BIGINT) AS n_flips FROM p GROUP BY read",
    "best_alignment_per_query": f"""WITH {ALN}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY e - s DESC, mapq DESC, target, s, ord, line, rev) AS n FROM aln)
SELECT query, target, s, e, rev, mapq FROM r WHERE n = 1""",
    "alignments_by_name": f"WITH {ALN}, {EXCL} SELECT query, target, s, e, rev, mapq, ord, line FROM aln WHERE mapq >= 50 AND query IN (SELECT name FROM excl)",
    "box_pairs": BOXES,
}
