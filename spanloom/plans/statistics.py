"""Queries on lengths, qualities, sets and phases, with DuckDB SQL for each."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from spanloom.functions import scalars
from spanloom.functions.distributions import student_cdf, student_p
from spanloom.functions.shipping import ship_package
from spanloom.operators import histograms as h
from spanloom.operators import learning, network, phasing, quality
from spanloom.operators.prefix import sorted_running
from spanloom.sources import views
from spanloom.sources.views import ALN, CAND, LENS, PHASE, QUAL

#: Width of a length bin, and of one of ``chimera_percent_whole``. The range is taken from the table.
WIDTH, WIDE = 200, 500


def threshold_sums(spark, sf_dir):
    return h.threshold_sums(views.lengths(spark, sf_dir), "length", [100, 1000, 2000, 5000, 10000], ("source",))


def region_histogram(spark, sf_dir):
    rows = views.alignments(spark, sf_dir).withColumn("mid", F.expr("(s + e) div 2"))
    return h.per_region(rows, "target", "mid", "e", 200)


def modulo_subsample(spark, sf_dir):
    return h.modulo_subsample(views.lengths(spark, sf_dir), "doc_id", 0.25).select("doc_id", "source", "length")


def _whole(spark, sf_dir, by=("lang",)):
    rows = views.lengths(spark, sf_dir)
    return h.histogram(rows, "length", 0, *h.whole_range(rows, "length", WIDTH), by)


def length_histogram_whole(spark, sf_dir):
    """Counts over a range taken from the table, so no length is left out; so are those of the other ``_whole`` queries."""
    return _whole(spark, sf_dir)


def length_density_whole(spark, sf_dir):
    return h.density(_whole(spark, sf_dir), ("lang",)).select("lang", "bin", "n", F.round("density", 6).alias("density"))


def weighted_histogram_whole(spark, sf_dir):
    return h.density(_whole(spark, sf_dir), ("lang",)).select("lang", "bin", F.round("bases", 3).alias("bases"))


def n50_whole(spark, sf_dir):
    return h.n50(_whole(spark, sf_dir), ("lang",))


def chimera_percent_whole(spark, sf_dir):
    rows = views.phases(spark, sf_dir).join(views.lengths(spark, sf_dir).select("doc_id", "length"), "doc_id").withColumn("flag", F.col("a") == 0)
    return h.class_percent(rows, "length", "flag", 0, *h.whole_range(views.lengths(spark, sf_dir), "length", WIDE))


def subsample_rates_whole(spark, sf_dir):
    rows = views.lengths(spark, sf_dir)
    stop, n_bins = h.whole_range(rows, "length", WIDTH)
    one = lambda lang: h.with_spine(h.histogram(rows.filter(F.col("lang") == lang), "length", 0, stop, n_bins), n_bins, 0, stop)
    return h.subsample_rates(one("en"), one("fr"), n_bins, 4.0)


WHOLE = f"WITH {LENS}, h AS (SELECT lang, CAST(length // {WIDTH} AS BIGINT) AS bin, count(*) AS n FROM lens WHERE length >= 0 GROUP BY ALL), c AS (SELECT lang, bin, (bin + 0.5) * {WIDTH}.0 AS center, n FROM h)"


def _whole_spine(lang):
    return f"SELECT i.bin, (i.bin + 0.5) * {WIDTH}.0 AS center, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT max(length) // {WIDTH} + 1 FROM lens))) AS bin) i LEFT JOIN (SELECT bin, n FROM h WHERE lang = '{lang}') x USING (bin)"


WHOLE_RATES = f"""{WHOLE}, t AS ({_whole_spine('en')}), s AS ({_whole_spine('fr')}),
b AS (SELECT t.bin, t.center, t.n / (SELECT sum(n) FROM t) AS td, s.n / (SELECT sum(n) FROM s) AS sd FROM t JOIN s ON t.bin = s.bin),
r AS (SELECT *, CASE WHEN td > 0 AND sd > 0 THEN td / sd ELSE 0.0 END AS ratio, row_number() OVER (ORDER BY round(center * (td - sd), 9) DESC, bin) AS k FROM b)
SELECT bin, round(ratio, 6) AS ratio, round(ratio / (SELECT least(coalesce(avg(ratio), 1.0), 4.0) FROM r WHERE k <= 20 AND ratio > 1), 6) AS rate FROM r"""


def max_bases_prefix(spark, sf_dir):
    return h.prefix_by_sum(views.lengths(spark, sf_dir), ["source"], ["doc_id"], "length", 20_000).select("doc_id", "source", "length", F.col("running").alias("running"))


def set_compare(spark, sf_dir):
    rows = views.alignments(spark, sf_dir)
    return phasing.set_compare(rows.filter("mapq >= 70").select("query"), rows.filter("mapq < 10").select("query"))


def _phases(spark, sf_dir):
    return phasing.refuse_conflicts(views.phases(spark, sf_dir), "doc_id")


def phase_confusion(spark, sf_dir):
    return phasing.confusion(_phases(spark, sf_dir))


def phase_ari(spark, sf_dir):
    return phasing.adjusted_rand(phase_confusion(spark, sf_dir)).select("component", "n", "ari")


def discordant_rows(spark, sf_dir):
    return phasing.discordant(_phases(spark, sf_dir), phase_confusion(spark, sf_dir))


CONF = f"""WITH {PHASE}, m AS (SELECT component, count(*) FILTER (WHERE a = 0 AND b = 0) AS n00, count(*) FILTER (WHERE a = 0 AND b = 1) AS n01,
  count(*) FILTER (WHERE a = 1 AND b = 0) AS n10, count(*) FILTER (WHERE a = 1 AND b = 1) AS n11, count(*) AS n FROM phase GROUP BY component)"""


def quality_halves(spark, sf_dir):
    out = quality.halves(views.qualities(spark, sf_dir))
    return out.select("read", "n", *[F.round(c, 6).alias(c) for c in ("left_mean", "left_var", "right_mean", "right_var")], "is_degraded")


HALVES = f"""WITH {QUAL}, p AS (SELECT read, pow(10.0, -q / 10.0) AS p, row_number() OVER (PARTITION BY read ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY read) AS n FROM qual),
v AS (SELECT read, max(n) AS n, avg(p) FILTER (WHERE i < n // 2) AS lm, var_pop(p) FILTER (WHERE i < n // 2) AS lv, avg(p) FILTER (WHERE i >= n // 2) AS rm, var_pop(p) FILTER (WHERE i >= n // 2) AS rv FROM p GROUP BY read)
SELECT read, n, round(lm, 6) AS left_mean, round(lv, 6) AS left_var, round(rm, 6) AS right_mean, round(rv, 6) AS right_var,
  coalesce(n >= 6 AND rm - lm > 0.09 AND rm >= 0.15 AND rv > lv AND rv > 0.025, false) AS is_degraded FROM v"""


def quality_smoothed(spark, sf_dir):
    out = quality.smoothed(views.qualities(spark, sf_dir), 4, 1.5)
    return out.select("read", "pos", F.round("smooth", 6).alias("smooth"))


SMOOTH = f"""WITH {QUAL}, p AS (SELECT read, pos, pow(10.0, -q / 10.0) AS p FROM qual), s AS (
  SELECT read, pos, {' + '.join(f"{'lag' if k < 0 else 'lead'}(p, {abs(k)}) OVER w * {weight!r}" for k, weight in zip(range(-4, 5), quality.kernel(4, 1.5)))} AS smooth
  FROM p WINDOW w AS (PARTITION BY read ORDER BY pos))
SELECT read, pos, round(smooth, 6) AS smooth FROM s WHERE smooth IS NOT NULL"""


def quality_breakpoint(spark, sf_dir):
    out = quality.breakpoint(views.qualities(spark, sf_dir), 5)
    return out.select("read", "cut", F.round("gain", 4).alias("gain"))


def quality_smoothed_to_the_ends(spark, sf_dir):
    out = quality.smoothed_to_the_ends(views.qualities(spark, sf_dir), 4, 1.5)
    return out.select("read", "pos", F.round("smooth", 6).alias("smooth"))


SMOOTH_ENDS = f"""WITH {QUAL}, p AS (SELECT read, pos, pow(10.0, -q / 10.0) AS p FROM qual)
SELECT read, pos, round({' + '.join(f"coalesce({'lag' if k < 0 else 'lead'}(p, {abs(k)}) OVER w, 0) * {weight!r}" for k, weight in zip(range(-4, 5), quality.kernel(4, 1.5)))}, 6) AS smooth
FROM p WINDOW w AS (PARTITION BY read ORDER BY pos)"""


def quality_penalised_breakpoint(spark, sf_dir):
    out = quality.penalised_breakpoint(views.qualities(spark, sf_dir), 5, 0.05)
    return out.select("read", "cut", F.round("score", 4).alias("score"))


def _cost(n, s1, s2):
    return f"({n}) * ({math.log(2 * math.pi)!r} + ln(greatest(({s2}) - ({s1}) * ({s1}) / ({n}), 0) / ({n}) + 1))"


PENALISED = f"""WITH {QUAL}, p AS (SELECT read, pos, pow(10.0, -q / 10.0) AS p FROM qual),
r AS (SELECT read, row_number() OVER w AS i, count(*) OVER a AS n, sum(p) OVER u AS l1, sum(p * p) OVER u AS l2, sum(p) OVER a AS a1, sum(p * p) OVER a AS a2
  FROM p WINDOW w AS (PARTITION BY read ORDER BY pos), u AS (PARTITION BY read ORDER BY pos ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY read)),
g AS (SELECT read, i, round({_cost('n', 'a1', 'a2')} - {_cost('i', 'l1', 'l2')} - {_cost('n - i', 'a1 - l1', 'a2 - l2')} - 0.05, 6) AS score FROM r WHERE i % 5 = 0 AND i < n),
k AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY score DESC, i) AS place FROM g WHERE score > 0)
SELECT read, i AS cut, round(score, 4) AS score FROM k WHERE place = 1"""


def quality_half_t(spark, sf_dir):
    out = quality.half_split_t(views.qualities(spark, sf_dir))
    return out.select("read", "n", F.round("t", 5).alias("t"), F.round("dof", 4).alias("dof"))


HALF_T = f"""WITH {QUAL}, p AS (SELECT read, pow(10.0, -q / 10.0) AS p, row_number() OVER (PARTITION BY read ORDER BY pos) AS i, count(*) OVER (PARTITION BY read) AS n FROM qual),
h AS (SELECT read, max(n) AS n, avg(p) FILTER (WHERE i <= n // 2) AS ml, var_pop(p) FILTER (WHERE i <= n // 2) AS vl, count(*) FILTER (WHERE i <= n // 2) AS nl,
  avg(p) FILTER (WHERE i > n // 2) AS mr, var_pop(p) FILTER (WHERE i > n // 2) AS vr, count(*) FILTER (WHERE i > n // 2) AS nr FROM p GROUP BY read),
e AS (SELECT *, vl / nullif(nl, 0) AS el, vr / nullif(nr, 0) AS er FROM h)
SELECT read, n, round((ml - mr) / nullif(sqrt(el + er), 0), 5) AS t, round((el + er) * (el + er) / nullif(el * el / nullif(nl - 1, 0) + er * er / nullif(nr - 1, 0), 0), 4) AS dof FROM e"""


def quality_half_p(spark, sf_dir):
    """``quality_half_t`` with the probabilities of a t as far from 0, and of one up to it."""
    out = quality.half_split_t(views.qualities(spark, sf_dir))
    return out.select("read", "n", F.round(student_p(F.col("t"), F.col("dof")), 6).alias("p"), F.round(student_cdf(F.col("t"), F.col("dof")), 6).alias("below"))


# the integral of Student's density beyond |t|, over the angle whose tangent is t / sqrt(dof), by Simpson's rule
_ANGLE = "(a + (pi() / 2 - a) * i / 4000.0)"
HALF_P = f"""{HALF_T.rsplit('SELECT read, n, round', 1)[0].rstrip()},
s AS (SELECT read, n, (ml - mr) / nullif(sqrt(el + er), 0) AS t, (el + er) * (el + er) / nullif(el * el / nullif(nl - 1, 0) + er * er / nullif(nr - 1, 0), 0) AS v FROM e),
g AS (SELECT *, atan(abs(t) / sqrt(v)) AS a FROM s),
q AS (SELECT read, n, t, v, CASE WHEN v >= 1 THEN 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(pi()) * (pi() / 2 - a) / 12000.0 * list_sum([CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(greatest(cos({_ANGLE}), 0), v - 1) FOR i IN range(4001)]) END AS p FROM g)
SELECT read, n, round(p, 6) AS p, round(CASE WHEN t > 0 THEN 1 - p / 2 ELSE p / 2 END, 6) AS below FROM q"""


def adaptive_histograms(spark, sf_dir):
    """Counts of the order lines' quantities by class, in as many bins as there are whole steps between the least and the largest."""
    rows = _features(spark, sf_dir)
    start, stop, n_bins = h.adaptive_range(rows, "l_quantity")
    return h.histogram(rows, "l_quantity", start, stop, n_bins, ("label",)).select("label", "bin", "n")


def sample_by_length(spark, sf_dir):
    return h.sample_by_length(views.lengths(spark, sf_dir), "doc_id", "length", 50, 1000).select("doc_id", "length")


def chromosome_order(spark, sf_dir):
    """Part containers and sizes as contig names, in their natural order."""
    names = views.table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), F.col("p_size").cast("string")).alias("name")).union(views.table(spark, sf_dir, "region").select(F.concat(F.lit("chr"), F.substring("r_name", 1, 2)))).distinct()
    return sorted_running(names, [*scalars.chromosome_order(F.col("name")), F.col("name")], {"place": F.lit(1).cast("long")})


def _like(s, n):
    return f"(({s}) * ln(({s}) / ({n})) + (({n}) - ({s})) * ln(1 - ({s}) / ({n})))"


BREAK = f"""WITH {QUAL}, p AS (SELECT read, pos, pow(10.0, -q / 10.0) AS p FROM qual),
r AS (SELECT read, row_number() OVER (PARTITION BY read ORDER BY pos) AS i, sum(p) OVER (PARTITION BY read ORDER BY pos ROWS UNBOUNDED PRECEDING) AS l, sum(p) OVER (PARTITION BY read) AS a, count(*) OVER (PARTITION BY read) AS n FROM p),
g AS (SELECT read, i, {_like('l', 'i')} + {_like('a - l', 'n - i')} - {_like('a', 'n')} AS gain FROM r WHERE i % 5 = 0 AND n - i >= 2)
SELECT read, arg_max(i, gain) AS cut, round(max(gain), 4) AS gain FROM g GROUP BY read"""


def threshold_totals(spark, sf_dir):
    """The 20 largest totals by source and threshold."""
    return threshold_sums(spark, sf_dir).orderBy(F.desc("total"), "source", "threshold").limit(20)


def _features(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_returnflag") == "R").cast("int").alias("label"))


RANGES = {"l_quantity": (0, 50), "l_extendedprice": (0, 100_000)}


def class_weights(spark, sf_dir):
    return learning.class_weights(_features(spark, sf_dir)).select("label", "n", F.round("weight", 9).alias("weight"))


def feature_histograms(spark, sf_dir):
    return learning.feature_histograms(_features(spark, sf_dir), RANGES, 25)


def overlap_classifier(spark, sf_dir):
    return learning.confusion_of_fit(_features(spark, sf_dir), "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def overlap_network(spark, sf_dir):
    """Confusion of a layered network, fitted on a balanced sample, over the whole test split, and its area under the ROC curve."""
    scored, area = network.network_fit(_features(ship_package(spark), sf_dir), "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    counts = scored.groupBy(F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return counts.withColumn("area", F.lit(area))


def balanced_sample(spark, sf_dir):
    """Rows of each class in a balanced sample of the order lines, and how many of them are different."""
    rows = _features(spark, sf_dir).withColumn("row", F.hash("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))
    return network.balanced(rows, "row").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("row").alias("n_rows"))


def node_degrees(spark, sf_dir):
    """Distinct nodes of the candidate edges with their number of edges and of neighbours."""
    e = views.candidates(spark, sf_dir)
    ends = e.select(F.col("n0").alias("name"), F.col("n1").alias("other")).union(e.select("n1", "n0"))
    ends = ends.repartition(2 * views.candidate_parts(spark, sf_dir), "name")
    return ends.groupBy("name").agg(F.count("*").alias("n_edges"), F.countDistinct("other").alias("n_neighbours"))


def _cell(f, stop):
    return f"SELECT '{f}' AS feature, label, CAST(CASE WHEN {f} = {stop} THEN 24 ELSE floor({f} / {stop / 25}) END AS BIGINT) AS bin FROM feat WHERE {f} >= 0 AND {f} <= {stop}"


_FEAT = "feat AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem)"
_THRESHOLDS = " UNION ALL ".join(f"SELECT source, CAST({t} AS BIGINT) AS threshold, CAST(coalesce(sum(length) FILTER (WHERE length > {t}), 0) AS BIGINT) AS total, count(*) FILTER (WHERE length > {t}) AS n FROM lens GROUP BY source" for t in (100, 1000, 2000, 5000, 10000))
QUERIES = {
    k: globals()[k]
    for k in (
        "threshold_sums threshold_totals region_histogram modulo_subsample "
        "length_histogram_whole length_density_whole weighted_histogram_whole n50_whole chimera_percent_whole subsample_rates_whole "
        "max_bases_prefix set_compare phase_confusion phase_ari discordant_rows quality_halves quality_smoothed quality_breakpoint quality_smoothed_to_the_ends quality_penalised_breakpoint quality_half_t quality_half_p adaptive_histograms sample_by_length chromosome_order "
        "class_weights feature_histograms overlap_classifier overlap_network balanced_sample node_degrees"
    ).split()
}
ORACLE = {
    "threshold_sums": f"WITH {LENS} {_THRESHOLDS}",
    "threshold_totals": f"WITH {LENS} SELECT * FROM ({_THRESHOLDS}) ORDER BY total DESC, source, threshold LIMIT 20",
    "region_histogram": f"""WITH {ALN}, r AS (SELECT target AS region, CAST(trunc((s + e) / 2) AS BIGINT) AS mid, e FROM aln), k AS (SELECT region, CAST(ceil(max(e) / 200.0) AS BIGINT) AS n_bins FROM r GROUP BY region),
c AS (SELECT region, CAST(floor(mid / 200.0) AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY ALL) SELECT c.region, c.bin, c.n, k.n_bins FROM c JOIN k ON c.region = k.region WHERE bin >= 0 AND bin < n_bins""",
    "modulo_subsample": f"WITH {LENS} SELECT doc_id, source, length FROM lens WHERE doc_id % 101 <= 24",
    "length_histogram_whole": f"{WHOLE} SELECT lang, bin, center, n FROM c",
    "length_density_whole": f"{WHOLE} SELECT lang, bin, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS density FROM c",
    "weighted_histogram_whole": f"{WHOLE} SELECT lang, bin, round(n * center, 3) AS bases FROM c",
    "n50_whole": f"{WHOLE}, r AS (SELECT *, sum(n * center) OVER (PARTITION BY lang ORDER BY bin) AS upto, sum(n * center) OVER (PARTITION BY lang) AS total FROM c) SELECT lang, min(center) AS n50 FROM r WHERE upto > total / 2 GROUP BY lang",
    "chimera_percent_whole": f"""WITH {PHASE}, {LENS}, b AS (SELECT CAST(length // {WIDE} AS BIGINT) AS bin, a = 0 AS flag FROM phase JOIN lens ON phase.doc_id = lens.doc_id WHERE length >= 0),
c AS (SELECT bin, count(*) FILTER (WHERE flag) AS yes, count(*) FILTER (WHERE NOT flag) AS no FROM b GROUP BY bin) SELECT bin, yes, no, round(100.0 * (yes + 1) / (yes + no + 2), 6) AS percent FROM c""",
    "subsample_rates_whole": WHOLE_RATES,
    "max_bases_prefix": f"WITH {LENS}, r AS (SELECT *, CAST(sum(length) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM lens) SELECT doc_id, source, length, running FROM r WHERE running - length < 20000",
    "set_compare": f"""WITH {ALN}, a AS (SELECT DISTINCT query FROM aln WHERE mapq >= 70), b AS (SELECT DISTINCT query FROM aln WHERE mapq < 10)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS only_b, (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS "both" """,
    "phase_confusion": f"{CONF} SELECT * FROM m",
    "phase_ari": f"""{CONF}, x AS (SELECT component, n, (n00 * (n00 - 1) + n01 * (n01 - 1) + n10 * (n10 - 1) + n11 * (n11 - 1)) / 2.0 AS i,
  ((n00 + n01) * (n00 + n01 - 1) + (n10 + n11) * (n10 + n11 - 1)) / 2.0 AS r, ((n00 + n10) * (n00 + n10 - 1) + (n01 + n11) * (n01 + n11 - 1)) / 2.0 AS c, n * (n - 1) / 2.0 AS t FROM m)
SELECT component, n, round((i - r * c / nullif(t, 0)) / nullif((r + c) / 2 - r * c / nullif(t, 0), 0), 6) AS ari FROM x""",
    "discordant_rows": f"{CONF} SELECT p.doc_id, p.component, p.a, p.b FROM phase p JOIN m ON p.component = m.component WHERE (p.a = p.b) <> (n00 + n11 >= n01 + n10)",
    "class_weights": f"WITH {_FEAT} SELECT label, count(*) AS n, round(1.0 / count(*), 9) AS weight FROM feat GROUP BY label",
    "feature_histograms": f"WITH {_FEAT} SELECT feature, label, bin, count(*) AS n FROM ({' UNION ALL '.join(_cell(f, b) for f, (_, b) in RANGES.items())}) GROUP BY ALL",
    "node_degrees": f"WITH {CAND} SELECT name, count(*) AS n_edges, count(DISTINCT other) AS n_neighbours FROM (SELECT n0 AS name, n1 AS other FROM cand UNION ALL SELECT n1, n0 FROM cand) GROUP BY name",
    "quality_halves": HALVES,
    "quality_smoothed": SMOOTH,
    "quality_breakpoint": BREAK,
    "quality_smoothed_to_the_ends": SMOOTH_ENDS,
    "quality_penalised_breakpoint": PENALISED,
    "quality_half_t": HALF_T,
    "quality_half_p": HALF_P,
    "adaptive_histograms": f"""WITH {_FEAT}, r AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, greatest(1, least(500, CAST(floor(max(l_quantity) - min(l_quantity)) AS BIGINT))) AS k FROM feat)
SELECT label, CAST(CASE WHEN l_quantity = b THEN k - 1 ELSE floor((l_quantity - a) / ((b - a) / k)) END AS BIGINT) AS bin, count(*) AS n FROM feat, r GROUP BY 1, 2""",
    "sample_by_length": f"WITH {LENS} SELECT doc_id, length FROM lens WHERE length >= 1000 ORDER BY md5('1:' || doc_id), doc_id LIMIT 50",
    "chromosome_order": r"""WITH n AS (SELECT DISTINCT 'chr' || p_size AS name FROM part UNION SELECT 'chr' || substr(r_name, 1, 2) FROM region)
SELECT name, row_number() OVER (ORDER BY CASE WHEN name[4:] ~ '^\d+$' THEN 0 WHEN name[4:] ~ '^[A-Za-z]+$' THEN 1 ELSE 2 END, TRY_CAST(name[4:] AS BIGINT) NULLS FIRST, name[4:], name) - 1 AS place FROM n""",
}
