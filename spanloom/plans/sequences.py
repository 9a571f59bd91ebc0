"""Queries on sequences, with DuckDB SQL where the operator has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import scalars
from spanloom.functions.edit_distance import edit_distance as best, nearest_parts
from spanloom.functions.shipping import ship_package
from spanloom.functions.scratch import stored
from spanloom.operators import align, boxes, chaining, cigars, graph, matches
from spanloom.operators.prefix import sorted_running, with_next
from spanloom.sources import views
from spanloom.sources.views import ALN, READS, REFERENCES
from spanloom.sql import register

K = 12


def reverse_complement(spark, sf_dir):
    return views.reads(spark, sf_dir).select("read", F.md5(scalars.reverse_complement(F.col("sequence"))).alias("digest"), F.length("sequence").cast("long").alias("size"))


def homopolymer_compress(spark, sf_dir):
    short = scalars.compress_homopolymers(F.col("sequence"))
    return views.reads(spark, sf_dir).select("read", F.md5(short).alias("digest"), F.length(short).cast("long").alias("size"))


def kmer_markers(spark, sf_dir):
    codes = scalars.kmers(F.col("sequence"), 6)
    kept = F.filter(codes, lambda x: scalars.is_marker(x, 0.1))
    return views.reads(spark, sf_dir).select("read", F.size(codes).cast("long").alias("n_kmers"), kept.alias("kept")).select("read", "n_kmers", F.size("kept").cast("long").alias("n_markers"), F.size(F.array_distinct("kept")).cast("long").alias("n_distinct"))


_DIGIT = "(CASE substr(kmer, {k} + 1, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END)"
_CODE = " + ".join(f"{4 ** (5 - k)} * {_DIGIT.format(k=k)}" for k in range(6))
MARKERS = f"""WITH {READS}, k AS (SELECT read, {_CODE} AS code FROM (SELECT read, unnest([substr(sequence, i, 6) FOR i IN range(1, length(sequence) - 4)]) AS kmer FROM reads))
SELECT r.read, coalesce(n, 0) AS n_kmers, coalesce(m, 0) AS n_markers, coalesce(d, 0) AS n_distinct FROM reads r
LEFT JOIN (SELECT read, count(*) AS n, count(*) FILTER (WHERE code % 101 < 10) AS m, count(DISTINCT code) FILTER (WHERE code % 101 < 10) AS d FROM k GROUP BY read) x ON r.read = x.read"""


def _neighbours(spark, sf_dir):
    """The reads, stored, and pairs of them from the same shelf of the library: each read with the next by id among those of like length (in hundreds)."""
    reads = stored(views.reads(ship_package(spark), sf_dir), "reads")
    lens = reads.select("read", F.expr("length(sequence) div 100").alias("shelf"))
    return with_next(lens, ["shelf"], [F.col("read")], {"b": "read"}).select(F.col("read").alias("a"), "b"), reads


PAIRS = "pairs AS (SELECT a, b FROM (SELECT read AS a, lead(read) OVER (PARTITION BY length(sequence) // 100 ORDER BY read) AS b FROM reads) WHERE b IS NOT NULL)"


def edit_distance(spark, sf_dir):
    """Edit distance of neighbouring part names."""
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    pairs = with_next(parts, ["p_brand"], [F.col("p_partkey")], {"two": "p_name"})
    return pairs.select("p_partkey", F.levenshtein("p_name", "two").cast("long").alias("distance"))


def part_distances(spark, sf_dir):
    """Part names within those of their neighbours: the least distance to any part of the next name and to its beginnings, and where that part ends."""
    parts = views.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    pairs = with_next(parts, ["p_brand"], [F.col("p_partkey")], {"two": "p_name"})
    both = [best(F.col("p_name"), F.col("two"), mode).alias(mode) for mode in ("infix", "prefix")]
    return pairs.select("p_partkey", *both).select("p_partkey", *[F.col(f"{m}.{c}").alias(f"{m}_{c}") for m in ("infix", "prefix") for c in ("distance", "stop")])


def _sql_column(row, first):
    """The next column of the dynamic program over p_name: entries are prefix minima, less their number."""
    y = f"list_concat([{first}], [least({row}[k + 1] + 1, {row}[k] + CASE WHEN p[k] = t[j + 1] THEN 0 ELSE 1 END) - k FOR k IN range(1, length(p) + 1)])"
    return f"[k + list_min(({y})[1:k + 1]) FOR k IN range(length(p) + 1)]"


def _sql_parts():
    return f"""WITH RECURSIVE n AS (SELECT p_partkey, p_name AS p, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS t FROM part),
d AS (
  SELECT p_partkey, p, t, CAST(0 AS BIGINT) AS j, range(length(p) + 1) AS i, range(length(p) + 1) AS b, length(p) AS im, CAST(0 AS BIGINT) AS ie, length(p) AS bm, CAST(0 AS BIGINT) AS be FROM n WHERE t IS NOT NULL
  UNION ALL
  SELECT p_partkey, p, t, j + 1, ni, nb, least(im, ni[-1]), CASE WHEN ni[-1] < im THEN j + 1 ELSE ie END, least(bm, nb[-1]), CASE WHEN nb[-1] < bm THEN j + 1 ELSE be END
  FROM (SELECT *, {_sql_column("i", "CAST(0 AS BIGINT)")} AS ni, {_sql_column("b", "j + 1")} AS nb FROM d WHERE j < length(t)))
SELECT p_partkey, im AS infix_distance, ie AS infix_stop, bm AS prefix_distance, be AS prefix_stop FROM d WHERE j = length(t)"""


MOTIF = "GATTACAGATTACAGATTACA"


def motif_in_reads(spark, sf_dir):
    """The part of each read that is nearest to a motif: its distance and where it ends."""
    return nearest_parts(views.reads(ship_package(spark), sf_dir).select("read", F.coalesce("sequence", F.lit("")).alias("sequence")), "read", "sequence", MOTIF)


def _cigars(spark, sf_dir):
    """Every alignment with a CIGAR made from it."""
    parts = [F.col("e") - F.col("s"), F.lit("M"), F.col("line"), F.lit("I"), F.pmod("query", F.lit(7)) + 1, F.lit("D"), F.lit("5=2X"), F.pmod("target", F.lit(9)) + 1, F.lit("S")]
    return views.alignments(spark, sf_dir).withColumn("ops", scalars.cigar_ops(F.concat(*[p.cast("string") for p in parts])))


def cigar_ops(spark, sf_dir):
    """Reference and query lengths of each alignment's CIGAR, and its last step's place on the reference."""
    rows = _cigars(spark, sf_dir)
    total = lambda keep: F.aggregate(F.filter("ops", lambda o: keep(o["op"])), F.lit(0).cast("long"), lambda acc, o: acc + o["len"])
    out = rows.select("query", "target", "ord", "line", "s", F.size("ops").cast("long").alias("n_ops"), total(scalars.consumes_reference).alias("on_reference"), total(scalars.consumes_query).alias("on_query"))
    return out.withColumn("stop", F.col("s") + F.col("on_reference"))


CIGAR = f"""WITH {ALN} SELECT query, target, ord, line, s, CAST(6 AS BIGINT) AS n_ops, (e - s) + (query % 7 + 1) + 7 AS on_reference,
  (e - s) + line + 7 + (target % 9 + 1) AS on_query, s + (e - s) + (query % 7 + 1) + 7 AS stop FROM aln"""


def cigar_segments(spark, sf_dir):
    """Where each step of an alignment runs on the reference and the query; clips are left out."""
    keys = ["query", "target", "ord", "line"]
    out = cigars.segments(_cigars(spark, sf_dir), keys, "s", "rev")
    return out.select(*keys, "step", "op", "x0", "x1", "y0", "y1")


SEGMENTS = f"""WITH {ALN}, o AS (
  SELECT a.*, k, CASE k WHEN 0 THEN 'M' WHEN 1 THEN 'I' WHEN 2 THEN 'D' WHEN 3 THEN '=' WHEN 4 THEN 'X' ELSE 'S' END AS op,
    CASE k WHEN 0 THEN e - s WHEN 1 THEN line WHEN 2 THEN query % 7 + 1 WHEN 3 THEN 5 WHEN 4 THEN 2 ELSE target % 9 + 1 END AS len
  FROM (SELECT *, row_number() OVER () AS rid FROM aln) a, (SELECT unnest(range(6)) AS k) x),
r AS (SELECT *, CASE WHEN op IN ('M', 'D', '=', 'X') THEN len ELSE 0 END AS dx, CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END AS dy FROM o),
c AS (SELECT *, CAST(sum(dx) OVER w - dx AS BIGINT) AS bx, CAST(sum(dy) OVER w - dy AS BIGINT) AS byy FROM r WINDOW w AS (PARTITION BY rid ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT query, target, ord, line, CAST(CASE WHEN rev THEN 5 - k ELSE k END AS BIGINT) AS step, op,
  CASE WHEN rev THEN s + bx + dx ELSE s + bx END AS x0, CASE WHEN rev THEN s + bx ELSE s + bx + dx END AS x1,
  CASE WHEN rev THEN byy + dy ELSE byy END AS y0, CASE WHEN rev THEN byy ELSE byy + dy END AS y1
FROM c WHERE op <> 'S'"""


def kmer_decode(spark, sf_dir):
    """The k-mers of each read decoded from their codes, as one digest."""
    return matches.spelled_digests(views.reads(ship_package(spark), sf_dir), 6)


def diagonal_places(spark, sf_dir):
    """Alignments' places turned to diagonals and back, in a matrix 8 high."""
    x, y = F.col("s") + 4000, F.col("line").cast("long")
    d, a = scalars.diagonal(x, y, 8), scalars.antidiagonal(x, y)
    rows = views.alignments(spark, sf_dir).select("query", "target", "ord", "line", d.alias("diagonal"), a.alias("antidiagonal"))
    return rows.withColumns({"x": scalars.x_of(F.col("diagonal"), F.col("antidiagonal"), F.lit(8)), "y": scalars.y_of(F.col("diagonal"), F.col("antidiagonal"), F.lit(8))})


def exact_matches(spark, sf_dir):
    return matches.exact_matches(*_neighbours(spark, sf_dir), K)


MATCHES = f"""WITH {READS}, {PAIRS}, k AS (SELECT read, unnest(range(0, length(sequence) - {K - 1})) AS pos, unnest([substr(sequence, i, {K}) FOR i IN range(1, length(sequence) - {K - 2})]) AS kmer FROM reads),
f AS (SELECT a, b, x.pos AS x, y.pos AS y FROM pairs JOIN k x ON x.read = a JOIN k y ON y.read = b AND y.kmer = x.kmer),
r AS (SELECT *, x - row_number() OVER (PARTITION BY a, b, x - y ORDER BY x) AS run FROM f),
m AS (SELECT a, b, min(x) AS x, min(y) AS y, count(*) + {K - 1} AS len FROM r GROUP BY a, b, x - y, run)"""


def dotplot_points(spark, sf_dir):
    return matches.points(exact_matches(spark, sf_dir), 5)


def match_heatmap(spark, sf_dir):
    return matches.heatmap(exact_matches(spark, sf_dir), 100)


def mean_match_position(spark, sf_dir):
    return matches.mean_position(exact_matches(spark, sf_dir), 5)


def match_shades(spark, sf_dir):
    cells = matches.log_heatmap(matches.heatmap(exact_matches(spark, sf_dir), 100))
    return cells.select("a", "b", "x_bin", "y_bin", F.round("shade", 6).alias("shade"))


def matches_by_position(spark, sf_dir):
    """Pairs in the order of their matches' mean place, ties by the reads."""
    out = sorted_running(mean_match_position(spark, sf_dir), [F.col("position"), F.col("a"), F.col("b")], {"place": F.lit(1).cast("long")})
    return out.select("a", "b", "position", "place")


def reference_unique_matches(spark, sf_dir):
    return matches.unique_matches(exact_matches(spark, sf_dir), False)


def unique_matches(spark, sf_dir):
    return matches.unique_matches(exact_matches(spark, sf_dir), True)


def dotplot_both_strands(spark, sf_dir):
    """Points of the matches on both strands, the second read's places moved up by 100,000."""
    pairs, reads = _neighbours(spark, sf_dir)
    moved = lambda df, k: matches.points(df, 5).select("a", "b", F.lit(k).alias("is_reverse"), "x", (F.col("y") + 100_000).alias("y"))
    return moved(matches.exact_matches(pairs, reads, K), False).union(moved(matches.reversed_matches(pairs, reads, K), True))


def merged_diagonals(spark, sf_dir):
    return matches.merged_diagonals(exact_matches(spark, sf_dir))


def matches_in_boxes(spark, sf_dir):
    """For each match the stretches that meet the box of 30 behind its last letter."""
    found = stored(exact_matches(spark, sf_dir), "matches")
    ends = found.select("a", "b", (F.col("x") + F.col("len")).alias("x"), (F.col("y") + F.col("len")).alias("y")).distinct()
    return matches.in_boxes(matches.merged_diagonals(found), ends, 30)


def rebased_matches(spark, sf_dir):
    rows = exact_matches(spark, sf_dir).withColumn("ord", F.col("x") * 100_000 + F.col("y"))
    return matches.rebased(rows, "ord")


def match_termini(spark, sf_dir):
    return matches.termini(exact_matches(spark, sf_dir), 50)


def match_extent(spark, sf_dir):
    return graph.extent(exact_matches(spark, sf_dir))


def next_matches(spark, sf_dir):
    return matches.next_matches(exact_matches(spark, sf_dir), 200)


NEXT = f"""{MATCHES}, n AS (
  SELECT p.a, p.b, p.x, p.y, q.x AS next_x, q.y AS next_y, q.x - p.x - p.len + q.y - p.y - p.len AS distance,
    row_number() OVER (PARTITION BY p.a, p.b, p.x, p.y ORDER BY q.x - p.x - p.len + q.y - p.y - p.len, q.x, q.y) AS k
  FROM m p JOIN m q ON p.a = q.a AND p.b = q.b AND q.x BETWEEN p.x + p.len AND p.x + p.len + 200 AND q.y BETWEEN p.y + p.len AND p.y + p.len + 200)
SELECT a, b, x, y, next_x, next_y, distance FROM n WHERE k = 1"""


def diagonal_nearest(spark, sf_dir):
    """From the end of each match, the nearest match that begins on each diagonal within 40 letters in both reads."""
    found = stored(exact_matches(spark, sf_dir), "matches")
    ends = found.select("a", "b", (F.col("x") + F.col("len")).alias("x"), (F.col("y") + F.col("len")).alias("y"))
    return boxes.nearest_on_diagonals(found, ends, ["a", "b"], 40)


DIAGONAL = f"""{MATCHES}, c AS (SELECT DISTINCT a, b, x + len AS x, y + len AS y FROM m), n AS (
  SELECT c.a, c.b, c.x, c.y, m.x - m.y AS diagonal, m.x AS near_x, m.y AS near_y, m.x + m.y - c.x - c.y AS distance,
    row_number() OVER (PARTITION BY c.a, c.b, c.x, c.y, m.x - m.y ORDER BY m.x + m.y) AS k
  FROM c JOIN m ON c.a = m.a AND c.b = m.b AND m.x BETWEEN c.x AND c.x + 40 AND m.y BETWEEN c.y AND c.y + 40)
SELECT a, b, x, y, diagonal, near_x, near_y, distance FROM n WHERE k = 1"""


LEAST, SEED = 20, 12


def reference_matches(spark, sf_dir):
    """Maximal exact matches of 20 letters or more of every read with every benchmark passage, as references."""
    reads = views.reads(ship_package(spark), sf_dir)
    return matches.against_references(reads, views.references(spark, sf_dir), LEAST, SEED)


REFERENCED = f"""WITH {READS}, {REFERENCES},
k AS (SELECT read, unnest(range(0, length(sequence) - {LEAST - 1})) AS pos, unnest([substr(sequence, i, {LEAST}) FOR i IN range(1, length(sequence) - {LEAST - 2})]) AS kmer FROM reads),
g AS (SELECT read, unnest(range(0, length(sequence) - {LEAST - 1})) AS pos, unnest([substr(sequence, i, {LEAST}) FOR i IN range(1, length(sequence) - {LEAST - 2})]) AS kmer FROM refs),
f AS (SELECT k.read AS a, g.read AS b, k.pos AS x, g.pos AS y FROM k JOIN g ON k.kmer = g.kmer),
r AS (SELECT *, x - row_number() OVER (PARTITION BY a, b, x - y ORDER BY x) AS run FROM f)
SELECT a, b, min(x) AS x, min(y) AS y, count(*) + {LEAST - 1} AS len FROM r GROUP BY a, b, x - y, run"""


def sql_matches(spark, sf_dir):
    """``exact_matches`` written in SQL alone, by the table function."""
    pairs, reads = _neighbours(register(spark), sf_dir)
    return spark.sql(
        f"""SELECT a, b, x, y, len FROM exact_matches(TABLE(
          SELECT a, b, one.sequence AS one, two.sequence AS two, {K} AS k FROM {{pairs}} JOIN {{reads}} AS one ON one.read = a JOIN {{reads}} AS two ON two.read = b) PARTITION BY (a, b))""",
        pairs=pairs, reads=reads,
    )


def sql_sequences(spark, sf_dir):
    """Scalar functions in SQL: checksums of a read's reverse complement and of its runs made single, and the code of its first 12 letters."""
    return register(spark).sql(
        """SELECT read, md5(reverse_complement(sequence)) AS turned, md5(compress_homopolymers(sequence)) AS single,
          kmer_code(left(sequence, 12)) AS code, kmer_letters(kmer_code(left(sequence, 12)), 12) AS letters FROM {reads} WHERE length(sequence) >= 12""",
        reads=views.reads(spark, sf_dir),
    )


_FIRST_CODE = " + ".join(f"{4 ** (11 - k)} * (CASE substr(sequence, {k + 1}, 1) WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 ELSE 3 END)" for k in range(12))
SQL_SEQUENCES = f"""WITH {READS} SELECT read, md5(reverse(translate(sequence, 'ACGT', 'TGCA'))) AS turned, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(sequence, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g')) AS single,
  CAST({_FIRST_CODE} AS BIGINT) AS code, left(sequence, 12) AS letters FROM reads WHERE length(sequence) >= 12"""


REACH = 100


def _chained(spark, sf_dir):
    sizes = views.reads(spark, sf_dir).select("read", F.length("sequence").cast("long").alias("size"))
    found = chaining.nodes(exact_matches(spark, sf_dir), sizes)
    return chaining.scores(found, chaining.edges(found, REACH), REACH)


def chain_scores(spark, sf_dir):
    """The score of the best chain that ends in each match of neighbouring reads."""
    return _chained(spark, sf_dir).select("a", "b", "x", "y", "len", "score")


CHAINED = f"""{MATCHES.replace('WITH ', 'WITH RECURSIVE ', 1)},
n AS (SELECT row_number() OVER () AS id, m.*, length(p.sequence) + length(q.sequence) AS total FROM m JOIN reads p ON p.read = a JOIN reads q ON q.read = b),
t AS (
  SELECT u.id AS u, v.id AS v, v.len AS gain, u.x - u.y AS d, v.x - v.y AS d2, v.x + v.y AS spot, v.x + v.y - (u.x + u.y + 2 * u.len - 2) - abs((v.x - v.y) - (u.x - u.y)) AS beyond
  FROM n u JOIN n v ON u.a = v.a AND u.b = v.b AND v.x >= u.x + u.len - 1 AND v.y >= u.y + u.len - 1 AND abs((v.x - v.y) - (u.x - u.y)) <= {REACH}),
nearest AS (SELECT *, row_number() OVER (PARTITION BY u, d2 ORDER BY spot, v) AS k FROM t WHERE beyond <= {REACH} + 1 - abs(d2 - d)),
edge AS (SELECT u, v, gain - CASE WHEN d = d2 THEN 0 ELSE abs(d2 - d) + 1 END AS w FROM nearest WHERE k = 1 AND u <> v),
reached(id, score) USING KEY (id) AS (
  SELECT id, CASE WHEN x <= {REACH} OR y <= {REACH} THEN greatest(len, -1 - total) ELSE -1 - total END FROM n
  UNION
  SELECT edge.v, max(reached.score + edge.w) FROM reached JOIN edge ON edge.u = reached.id JOIN recurring.reached AS old ON old.id = edge.v GROUP BY edge.v, old.score HAVING max(reached.score + edge.w) > old.score)
SELECT a, b, x, y, len, score FROM n JOIN reached ON n.id = reached.id"""


def chain_steps(spark, sf_dir):
    """The matches of the best chain of each pair of neighbouring reads, in order."""
    return chaining.best_chains(_chained(spark, sf_dir), REACH)


def dag_chain(spark, sf_dir):
    sizes = views.reads(spark, sf_dir).select("read", F.length("sequence").cast("long").alias("size"))
    ship_package(spark)
    return align.chain_matches(exact_matches(spark, sf_dir), sizes, 100)


def gap_affine_align(spark, sf_dir):
    """Neighbouring part names of a brand, aligned."""
    parts = views.table(ship_package(spark), sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    pairs = with_next(parts, ["p_brand"], [F.col("p_partkey")], {"two": "p_name"}).withColumnRenamed("p_name", "one")
    return pairs.withColumn("r", align.align(F.col("one"), F.col("two"))).select("p_partkey", F.col("r.cost").alias("cost"), F.col("r.cigar").alias("cigar"))


UNIQUE = """u AS (SELECT *, EXISTS (SELECT 1 FROM m q WHERE q.a = p.a AND q.b = p.b AND (q.x, q.y) <> (p.x, p.y) AND q.y <= p.y AND q.y + q.len >= p.y + p.len) AS cy,
  EXISTS (SELECT 1 FROM m q WHERE q.a = p.a AND q.b = p.b AND (q.x, q.y) <> (p.x, p.y) AND q.x <= p.x AND q.x + q.len >= p.x + p.len) AS cx FROM m p)"""
BOTH = f"""WITH {READS}, {PAIRS}, k AS (SELECT read, unnest(range(0, length(sequence) - {K - 1})) AS pos, unnest([substr(sequence, i, {K}) FOR i IN range(1, length(sequence) - {K - 2})]) AS kmer FROM reads),
turned AS (SELECT read, length(sequence) AS size, reverse(translate(sequence, 'ACGT', 'TGCA')) AS sequence FROM reads),
kt AS (SELECT read, size, unnest(range(0, length(sequence) - {K - 1})) AS pos, unnest([substr(sequence, i, {K}) FOR i IN range(1, length(sequence) - {K - 2})]) AS kmer FROM turned),
f AS (SELECT a, b, false AS is_reverse, CAST(0 AS BIGINT) AS size, x.pos AS x, y.pos AS y FROM pairs JOIN k x ON x.read = a JOIN k y ON y.read = b AND y.kmer = x.kmer
  UNION ALL SELECT a, b, true, size, x.pos, y.pos FROM pairs JOIN k x ON x.read = a JOIN kt y ON y.read = b AND y.kmer = x.kmer),
r AS (SELECT *, x - row_number() OVER (PARTITION BY a, b, is_reverse, x - y ORDER BY x) AS run FROM f),
g AS (SELECT a, b, is_reverse, size, min(x) AS x, min(y) AS y, count(*) + {K - 1} AS len FROM r GROUP BY a, b, is_reverse, size, x - y, run),
m AS (SELECT a, b, is_reverse, x, CASE WHEN is_reverse THEN size - y - len ELSE y END AS y, len FROM g)"""
STRETCHES = """c AS (SELECT a, b, x - y AS diagonal, x + y AS start, x + y + len - 1 AS stop FROM m),
e AS (SELECT *, max(stop) OVER (PARTITION BY a, b, diagonal ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
i AS (SELECT *, sum(CASE WHEN start <= prev + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY a, b, diagonal ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM e),
stretches AS (SELECT a, b, diagonal, min(start) AS start, max(stop) AS stop FROM i GROUP BY a, b, diagonal, island)"""


def _sql_pairs():
    return "WITH n AS (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS two FROM part)"


QUERIES = {k: globals()[k] for k in "reverse_complement homopolymer_compress kmer_markers edit_distance part_distances motif_in_reads cigar_ops cigar_segments kmer_decode diagonal_places exact_matches dotplot_points match_heatmap mean_match_position match_shades matches_by_position reference_unique_matches unique_matches dotplot_both_strands merged_diagonals matches_in_boxes rebased_matches match_termini match_extent next_matches diagonal_nearest reference_matches sql_matches sql_sequences chain_scores chain_steps dag_chain gap_affine_align".split()}
ORACLE = {
    "reverse_complement": f"WITH {READS} SELECT read, md5(reverse(translate(sequence, 'ACGT', 'TGCA'))) AS digest, length(sequence) AS size FROM reads",
    "homopolymer_compress": f"WITH {READS}, c AS (SELECT read, regexp_replace(regexp_replace(regexp_replace(regexp_replace(sequence, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS s FROM reads) SELECT read, md5(s) AS digest, length(s) AS size FROM c",
    "kmer_markers": MARKERS,
    "part_distances": _sql_parts(),
    "edit_distance": f"{_sql_pairs()} SELECT p_partkey, levenshtein(p_name, two) AS distance FROM n WHERE two IS NOT NULL",
    "cigar_ops": CIGAR,
    "exact_matches": f"{MATCHES} SELECT a, b, x, y, len FROM m",
    "dotplot_points": f"{MATCHES} SELECT a, b, x + t AS x, y + t AS y FROM (SELECT a, b, x, y, unnest(range(0, len, 5)) AS t FROM m)",
    "match_heatmap": f"{MATCHES} SELECT a, b, CAST(floor(x / 100.0) AS BIGINT) AS x_bin, CAST(floor(y / 100.0) AS BIGINT) AS y_bin, max(len) AS longest FROM m GROUP BY ALL",
    "cigar_segments": SEGMENTS,
    "kmer_decode": f"WITH {READS} SELECT read, md5(coalesce(array_to_string([substr(sequence, i, 6) FOR i IN range(1, length(sequence) - 4)], ','), '')) AS digest FROM reads",
    "diagonal_places": f"WITH {ALN} SELECT query, target, ord, line, 7 - line + s + 4000 AS diagonal, s + 4000 + line AS antidiagonal, s + 4000 AS x, CAST(line AS BIGINT) AS y FROM aln",
    "match_shades": f"{MATCHES}, h AS (SELECT a, b, x // 100 AS x_bin, y // 100 AS y_bin, max(len) AS longest FROM m GROUP BY ALL) SELECT a, b, x_bin, y_bin, round(ln(longest + 1) / ln(max(longest) OVER (PARTITION BY a, b) + 1), 6) AS shade FROM h",
    "matches_by_position": f"{MATCHES}, p AS (SELECT a, b, CAST(floor(sum(x * ceil(len / 5.0)) / sum(ceil(len / 5.0))) AS BIGINT) AS position FROM m GROUP BY a, b) SELECT a, b, position, row_number() OVER (ORDER BY position, a, b) - 1 AS place FROM p",
    "reference_unique_matches": f"{MATCHES}, {UNIQUE} SELECT a, b, x, y, len FROM u WHERE NOT cy",
    "unique_matches": f"{MATCHES}, {UNIQUE} SELECT a, b, x, y, len FROM u WHERE NOT cy AND NOT cx",
    "dotplot_both_strands": f"{BOTH} SELECT a, b, is_reverse, x + t AS x, y + t + 100000 AS y FROM (SELECT *, unnest(range(0, len, 5)) AS t FROM m)",
    "merged_diagonals": f"{MATCHES}, {STRETCHES} SELECT a, b, diagonal, start, stop FROM stretches",
    "matches_in_boxes": f"""{MATCHES}, {STRETCHES}, ends AS (SELECT DISTINCT a, b, x + len AS x, y + len AS y FROM m),
lines AS (SELECT *, x - y + t AS diagonal, x + y + abs(t) AS low, 31 - abs(t) AS space FROM (SELECT *, unnest(range(-30, 31)) AS t FROM ends))
SELECT l.a, l.b, l.x, l.y, (s.start + s.diagonal) // 2 AS at_x, (s.start - s.diagonal) // 2 AS at_y, s.stop - s.start + 1 AS len
FROM lines l JOIN stretches s ON l.a = s.a AND l.b = s.b AND l.diagonal = s.diagonal AND s.start <= l.low + l.space AND s.stop >= l.low""",
    "rebased_matches": f"""{MATCHES}, o AS (SELECT *, x * 100000 + y AS ord FROM m), st AS (SELECT a, b, arg_min(x, ord) AS fx, arg_min(y, ord) AS fy FROM o GROUP BY a, b)
SELECT o.a, o.b, ord, CASE WHEN fy > fx THEN y - fy ELSE x - fx END AS x, CASE WHEN fy > fx THEN x - fx ELSE y - fy END AS y FROM o JOIN st ON o.a = st.a AND o.b = st.b""",
    "match_termini": f"""{MATCHES}, t AS (SELECT a, b, x - y AS diagonal, x, k AS kind, x + y + CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 * len ELSE 2 * len + 50 END AS antidiagonal FROM m, (VALUES (0), (1), (2)) v(k))
SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY antidiagonal, kind, diagonal, x) - 1 AS place FROM t""",
    "match_extent": f"{MATCHES} SELECT max(x) AS x_max, max(y) AS y_max FROM m",
    "next_matches": NEXT,
    "chain_scores": CHAINED,
    "sql_matches": f"{MATCHES} SELECT a, b, x, y, len FROM m",
    "sql_sequences": SQL_SEQUENCES,
    "diagonal_nearest": DIAGONAL,
    "reference_matches": REFERENCED,
    "mean_match_position": f"{MATCHES} SELECT a, b, CAST(floor(sum(x * ceil(len / 5.0)) / sum(ceil(len / 5.0))) AS BIGINT) AS position FROM m GROUP BY a, b",
}
