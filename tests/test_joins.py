"""Joins of intervals, boxes and sequences, distances and distributions, against brute force."""

import collections
import math
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions.distributions import student_cdf, student_p
from spanloom.functions.edit_distance import MODES, edit_distance
from spanloom.functions.scratch import stored
from spanloom.operators import blocks, boxes, graph, intervals, learning, matches, network, phasing
from spanloom.sql import register


def column(pattern, text, mode):
    row = list(range(len(pattern) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0 if mode == "infix" else j]
        for i, x in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (x != c)))
        row = new
        if row[-1] < best[0]:
            best = (row[-1], j)
    return (row[-1], len(text)) if mode == "whole" else best


@pytest.mark.parametrize("mode", MODES)
def test_edit_distance_equals_the_dynamic_program(spark, mode):
    r = random.Random(6)
    rows = [("", "abc"), ("abc", ""), ("", ""), ("é😀", "xé😀y"), ("a" * 62, "a" * 61 + "b"), ("a" * 63, "b" + "a" * 62)]
    for _ in range(120):
        a = r.choices("ACGT", k=r.choice([1, 5, 30, 61, 62, 63, 124, 125, 190]))
        b = list(a)
        for _ in range(r.randrange(8)):
            k = r.randrange(len(b) + 1)
            b[k : k + r.randrange(2)] = r.choices("ACGT", k=r.randrange(2))
        rows.append(("".join(a), "".join(r.choices("ACGT", k=r.randrange(30)) + b + r.choices("ACGT", k=r.randrange(30)))))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, p string, t string")
    got = {x.k: tuple(x.d) for x in df.select("k", edit_distance(F.col("p"), F.col("t"), mode).alias("d")).collect()}
    assert got == {k: column(a, b, mode) for k, (a, b) in enumerate(rows)}
    assert spark.range(1).select(edit_distance(F.lit(None).cast("string"), F.lit("a"), mode).alias("d")).first().d is None


def test_motif_in_reads(spark, sf):
    from spanloom.plans import sequences
    from spanloom.sources import views

    got = {r.read: (r.distance, r.stop) for r in sequences.motif_in_reads(spark, sf).collect()}
    reads = {r.read: r.sequence or "" for r in views.reads(spark, sf).collect()}
    assert set(got) == set(reads)
    m = len(sequences.MOTIF)
    for read, text in reads.items():
        if len(text) < 2500:
            assert got[read] == column(sequences.MOTIF, text, "infix")
        else:  # longer ones by numpy, whole columns along the text at once
            row = np.zeros(len(text) + 1, dtype=np.int64)
            letters = np.array(list(text))
            for i, c in enumerate(sequences.MOTIF, 1):
                new = np.minimum(row[1:] + 1, row[:-1] + (letters != c))
                # insertions run along the text
                new = np.concatenate([[i], new])
                at = np.arange(len(new))
                row = np.minimum.accumulate(new - at) + at
            assert got[read] == (int(row.min()), int(row.argmin())) and row[0] == m


def edges_of(rows):
    out = set()
    for k, (t, q, s, e, rev, _) in enumerate(rows):
        for t2, q2, s2, e2, rev2, _ in rows:
            if t == t2 and q < q2 and s < e2 and s2 < e and s < e and s2 < e2:
                out.add((q, q2, rev != rev2))
    return out


ALN = "target string, query long, s long, e long, rev boolean, mapq int"


def test_deep_bins_are_cut_in_blocks(spark):
    r = random.Random(1)
    rows = [("hot" if k % 3 == 0 else r.choice("abc"), r.randrange(60), s := r.randrange(300), s + r.randrange(60), r.random() < 0.5, 60) for k in range(400)]
    df = spark.createDataFrame(rows, ALN)
    for bound in (2000, 7):
        got = [tuple(x) for x in intervals.overlap_edges(df, 50, bound=bound).collect()]
        assert len(got) == len(set(got)) and set(got) == edges_of(rows)
    assert {tuple(x) for x in intervals.overlap_edges(df, 50, width=None).collect()} == edges_of(rows)


def test_one_target_with_a_third_of_all_rows_is_dealt_out(spark):
    """Pairs that a task compares: no block of the grid holds much more than the bound on either side, whatever the depth."""
    rows = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', 't' || id % 300) AS target", "id AS query", "0L AS s", "10L AS e", "false AS rev", "0L AS bin")
    joined = blocks.self_pairs(rows, ["target", "bin"], lambda a, b: F.col(f"{a}.query") < F.col(f"{b}.query"), bound=200)
    units = joined.groupBy("a.target", "a._i", "a._j").agg(F.count("*").alias("n"), F.countDistinct("a.query").alias("left"), F.countDistinct("b.query").alias("right")).collect()
    hot = [u for u in units if u.target == "hot"]
    assert max(u.left for u in hot) < 270 and max(u.right for u in hot) < 270 and len(hot) == 225
    assert sum(u.n for u in hot) == 3000 * 2999 // 2


def test_coverage_is_the_same_for_any_width(spark):
    r = random.Random(8)
    rows = [(r.choice(["t", "u", None]), r.randrange(12), s := r.randrange(150), s + r.choice([0, 1, 5, 40, 200]), r.random() < 0.5, 60) for _ in range(60)]
    df = spark.createDataFrame(rows, ALN)
    want = set()
    for t in ("t", "u"):
        own = [(s, e, 2 * q + rev) for t2, q, s, e, rev, _ in rows if t2 == t and s < e]
        sets, now = [], None
        for at in range(0, 400):
            ids = tuple(sorted({i for s, e, i in own if s <= at < e}))
            if now and now[2] == ids:
                now[1] = at + 1
            else:
                now = [at, at + 1, ids]
                sets.append(now)
        want |= {(t, a, b, len(i), ",".join(map(str, i))) for a, b, i in sets if i}
    for width in (1, 7, 64, 1000):
        got = [tuple(x) for x in intervals.coverage_segments(df, 50, width).collect()]
        assert len(got) == len(set(got)) and {x for x in got if x[0]} == want


@pytest.mark.parametrize("bound", [5, 2000])
def test_boxes_meet_in_tiles_of_any_level(spark, bound):
    r = random.Random(3)
    rows = []
    for k in range(250):
        x, y = (r.randrange(20), r.randrange(20)) if k % 2 else (r.randrange(-200, 400), r.randrange(-200, 400))
        rows.append((r.choice("ab"), k, x, x + r.choice([0, 1, 3, 70]), y, y + r.choice([1, 2, 9, 130])))
    df = spark.createDataFrame(rows, "g string, id long, x0 long, x1 long, y0 long, y1 long")
    got = [(p.a, p.b) for p in boxes.intersecting(df, ["g"], ["id"], 64, bound).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).collect()]
    want = {(p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and max(p[2], q[2]) < min(p[3], q[3]) and max(p[4], q[4]) < min(p[5], q[5])}
    assert len(got) == len(set(got)) and set(got) == want
    levels = {x["_level"] for x in boxes.tiled(df, ["g"], 64, bound).select("_level").distinct().collect()}
    assert (len(levels) > 1) == (bound == 5)


def test_nearest_on_diagonals(spark):
    r = random.Random(2)
    points = [(r.choice([1, 2]), r.randrange(60), r.randrange(60)) for _ in range(500)]
    corners = [(r.choice([1, 2]), r.randrange(60), r.randrange(60)) for _ in range(80)]
    got = {tuple(x) for x in boxes.nearest_on_diagonals(spark.createDataFrame(points * 2, "g int, x long, y long"), spark.createDataFrame(corners, "g int, x long, y long"), ["g"], 9).collect()}
    want = {}
    for g, x, y in corners:
        for h, px, py in points:
            if g == h and x <= px <= x + 9 and y <= py <= y + 9:
                key = (g, x, y, px - py)
                want[key] = min(want.get(key, (10**9,)), (px + py - x - y, px, py))
    assert got == {(*k, px, py, d) for k, (d, px, py) in want.items()}


def brute_matches(one, two, least):
    out = set()
    for i in range(len(one)):
        for j in range(len(two)):
            if one[i] != two[j] or one[i] not in "ACGT" or (i and j and one[i - 1] == two[j - 1] and one[i - 1] in "ACGT"):
                continue
            n = 0
            while i + n < len(one) and j + n < len(two) and one[i + n] == two[j + n] and one[i + n] in "ACGT":
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


def test_seeds_of_random_and_repeated_sequences():
    r = random.Random(4)
    for letters in ("ACGT", "AC", "A", "ACGTN", "AN"):
        for _ in range(25):
            one, two = ("".join(r.choices(letters, k=r.randrange(40))) for _ in range(2))
            got = list(zip(*map(list, matches.seeds(one, two, 4))))
            assert len(got) == len(set(got)) and {tuple(map(int, g)) for g in got} == brute_matches(one, two, 4)


def test_repeats_take_memory_with_their_matches_only():
    tracemalloc.start()
    x, y, n = matches.seeds("A" * 100_000, "A" * 100_000, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(x) == 2 * (100_000 - 11) - 1 and int(n.max()) == 100_000 and peak < 500e6


@pytest.mark.parametrize("bound", [3, 2000])
def test_matches_with_references(spark, bound):
    r = random.Random(9)
    refs = ["".join(r.choices("ACGT", k=120)) for _ in range(4)] + ["ACGT" * 25, "A" * 70, ""]
    reads = []
    for _ in range(14):
        ref = r.choice(refs) or "ACGTTT"
        at = r.randrange(len(ref))
        reads.append("".join(r.choices("ACGTN", k=r.randrange(20))) + ref[at : at + r.randrange(10, 60)] + "".join(r.choices("ACGT", k=r.randrange(20))))
    reads += ["ACGT" * 15, "A" * 40, None]
    table = lambda xs: stored(spark.createDataFrame([(k, x) for k, x in enumerate(xs)] + [(None, "ACGT" * 20)], "read long, sequence string"), "sequences")
    got = [tuple(x) for x in matches.against_references(table(reads), table(refs), 14, 6, bound).collect()]
    want = {(i, j, *m) for i, a in enumerate(reads) for j, b in enumerate(refs) for m in brute_matches(a or "", b, 14)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_distances_at_any_radius(spark):
    r = random.Random(5)
    pairs = {(min(p), max(p)) for p in ((r.randrange(60), r.randrange(60)) for _ in range(70)) if p[0] != p[1]} | {(k, k + 1) for k in range(100, 130)}
    near = collections.defaultdict(set)
    for u, v in pairs:
        near[u].add(v)
        near[v].add(u)
    edges = spark.createDataFrame(sorted(pairs), "u long, v long")
    for start in ([0, 1], [100], [7, 7, 115], [999]):
        want, level = dict.fromkeys(start, 0), list(set(start))
        while level:
            level = [v for v in {v for u in level for v in near[u]} if v not in want and not want.update({v: want[min((u for u in near[v] if u in want), key=want.get)] + 1})]
        assert {x.node: x.distance for x in graph.distances(edges, start).collect()} == want
        for radius in (0, 1, 3):
            assert {x.node: x.distance for x in graph.distances(edges, start, radius).collect()} == {n: d for n, d in want.items() if d <= radius}
            kept = {tuple(x) for x in graph.subgraph(edges, start, radius).collect()}
            assert kept == {(u, v) for u, v in pairs if min(want.get(u, 99), want.get(v, 99)) < radius}


def test_a_step_of_the_search_does_not_shuffle_edges(spark):
    near = spark.range(1000).selectExpr("id % 50 AS node", "id AS far")
    near.write.bucketBy(4, "node").sortBy("node").mode("overwrite").saveAsTable("adjacency_plan_test")
    try:
        plan = spark.table("adjacency_plan_test").hint("merge").join(stored(spark.range(20).toDF("node"), "f"), "node")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1
    finally:
        spark.sql("DROP TABLE adjacency_plan_test")


def test_student_p_equals_integrals(spark):
    def p_of(t, v):
        a, n = math.atan(abs(t) / math.sqrt(v)), 4000
        f = [max(math.cos(a + (math.pi / 2 - a) * k / n), 0.0) ** (v - 1) for k in range(n + 1)]
        s = (math.pi / 2 - a) / n / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
        return 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * s

    rows = [(t, v) for t in (-9.0, -2.5, -0.3, 0.0, 0.7, 1.96, 5.0) for v in (1.0, 2.0, 3.7, 10.0, 58.3, 400.0)]
    for x in spark.createDataFrame(rows, "t double, v double").select("*", student_p(F.col("t"), F.col("v")).alias("p"), student_cdf(F.col("t"), F.col("v")).alias("below")).collect():
        want = p_of(x.t, x.v)
        assert abs(x.p - want) < 1e-6 and abs(x.below - (1 - want / 2 if x.t > 0 else want / 2)) < 1e-6
    # printed tables
    for t, v, p in ((12.706, 1.0, 0.05), (2.228, 10.0, 0.05), (3.169, 10.0, 0.01), (1.984, 100.0, 0.05)):
        assert abs(spark.range(1).select(student_p(F.lit(t), F.lit(v)).alias("p")).first().p - p) < 5e-5


def test_balanced_samples_agree_on_every_run(spark):
    rows = spark.range(60_000).selectExpr("id", "cast(id % 12 = 0 as int) AS label")
    one = sorted(tuple(x) for x in network.balanced(rows, "id").collect())
    assert one == sorted(tuple(x) for x in network.balanced(rows.repartition(7), "id").collect())
    n = collections.Counter(label for _, label in one)
    assert abs(n[0] - n[1]) < 0.02 * n[0] and abs(n[0] + n[1] - 60_000) < 1200
    times = collections.Counter(i for i, label in one if label == 1)
    rate = 6.0
    for k in range(3, 10):
        share = sum(1 for c in times.values() if c == k) / 5000
        assert abs(share - math.exp(-rate) * rate**k / math.factorial(k)) < 0.02
    assert sum(1 for _ in network.balanced(rows, "id", size=600).collect()) < 800


def test_a_network_learns_what_is_not_linear(spark):
    rows = spark.range(3000).selectExpr("id", "(xxhash64(id) % 1000) / 1000D AS x", "(xxhash64(id, 7) % 1000) / 1000D AS y").selectExpr("*", "cast(x * y > 0.05 as int) AS label")
    scored, area = network.network_fit(rows, "id", ["x", "y"], hidden=(16, 16), steps=120)
    test = [(r.label, r.probability[1]) for r in scored.collect()]
    pos, neg = [p for c, p in test if c], [p for c, p in test if not c]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert area > 0.9 and abs(area - wins) < 0.01


def test_a_network_scores_rows_once_and_as_spark_does(spark, monkeypatch):
    """Scored rows are read from a stored table, whatever is asked of them, and equal those of Spark's own model."""
    models = []
    fit = network.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(network.MultilayerPerceptronClassifier, "fit", lambda self, df: models.append((fit(self, df), df)) or models[0][0])
    rows = spark.range(20_000).selectExpr("id", "(xxhash64(id) % 1000) / 10D AS x", "cast(xxhash64(id, 7) % 1000 as int) AS y", "3 AS z").selectExpr("*", "cast(x * y > 5000 as int) AS label")
    scored, area = network.network_fit(rows, "id", ["x", "y", "z"], hidden=(16, 8), steps=40)
    assert scored.inputFiles() and all("/scored-" in f for f in scored.inputFiles())
    train, test = learning.split(rows, "id")
    assembler = network.VectorAssembler(inputCols=["x", "y", "z"], outputCol="raw")
    scaler = network.StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(assembler.transform(train))
    want = models[0][0].transform(scaler.transform(assembler.transform(test)))
    assert abs(area - network.BinaryClassificationEvaluator(labelCol="label", numBins=0).evaluate(want)) < 1e-6
    one, two = ({r.id: r for r in df.collect()} for df in (scored, want))
    assert one.keys() == two.keys() and len(one) > 7000
    for i, r in one.items():
        assert r.prediction == two[i].prediction
        assert max(abs(r.rawPrediction.toArray() - two[i].rawPrediction.toArray())) < 1e-9
        assert max(abs(r.probability.toArray() - two[i].probability.toArray())) < 1e-9
    with pytest.raises(Exception, match="null or NaN"):
        network.scored_rows(rows.selectExpr("id", "if(id = 9, null, x) AS x"), ["x"], 0.0, 1.0, [1, 2], np.ones(4))


def test_reads_in_both_haplotypes_are_refused(spark):
    good = spark.createDataFrame([(1, "c", 0, 1), (2, "c", 1, 1), (2, "c", 1, 1), (None, "c", 0, 0), (None, "c", 1, 0)], "doc_id long, component string, a int, b int")
    assert phasing.refuse_conflicts(good, "doc_id").count() == 5
    for bad in ((1, "c", 1, 1), (2, "c", 1, 0)):
        with pytest.raises(Exception, match="both haplotypes"):
            phasing.refuse_conflicts(good.union(spark.createDataFrame([bad], good.schema)), "doc_id").collect()


def test_functions_in_sql(spark):
    row = register(spark).sql("""SELECT reverse_complement('aCgT') AS r, reverse_complement('AN') AS n, compress_homopolymers('AACCCG') AS c, kmer_letters(kmer_code('GATTACA'), 7) AS k,
      kmer_code('AN') AS none, cigar_ops('10M2I') AS ops, reference_length('10M2I3D4S') AS on_reference, query_length('10M2I3D4S') AS on_query, error_probability('+') AS p""").first()
    assert (row.r, row.n, row.c, row.k, row.none, [tuple(o) for o in row.ops], row.on_reference, row.on_query) == ("ACGT", None, "ACG", "GATTACA", None, [("M", 10), ("I", 2)], 13, 16)
    assert abs(row.p - 0.1) < 1e-12
    got = spark.sql("SELECT x, y, len FROM exact_matches(TABLE(SELECT 1L AS a, 2L AS b, 'GATTACAGATTACA' AS one, 'TTGATTACATT' AS two, 5 AS k) PARTITION BY (a, b))").collect()
    assert {tuple(g) for g in got} == brute_matches("GATTACAGATTACA", "TTGATTACATT", 5)
