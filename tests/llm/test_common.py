"""Ranks over buckets, let-bindings, checked broadcasts and stored tables."""

import random

from pyspark.sql import functions as F

from spanloom.functions import scratch
from spanloom.llm import common, lookups, ranks


def test_running_sums_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(k, r.choice("ab"), r.random(), r.randint(0, 9)) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, x double, v long").withColumn("bucket", F.floor(F.col("x") * 1500))
    got = {t.id: (t.rank, t.before) for t in ranks.running(df, ["g"], "bucket", [F.col("x"), F.col("id")], {"rank": F.lit(1), "before": F.col("v")}).collect()}
    for g in "ab":
        total = 0
        for k, (i, _, _, v) in enumerate(sorted((t for t in rows if t[1] == g), key=lambda t: (t[2], t[0]))):
            assert got[i] == (k, total)
            total += v
    everywhere = ranks.running(df, [], "bucket", [F.col("x"), F.col("id")], {"rank": F.lit(1)})
    assert sorted(t["rank"] for t in everywhere.collect()) == list(range(3000))


def test_words_and_keys(spark):
    df = spark.createDataFrame([("a  b\tc\x0bd\x0ce\r\nf",), ("  ",), (None,), ("a b",)], "t string")
    assert [r[0] for r in df.select(common.words(F.col("t"))).collect()] == [list("abcdef"), [], [], ["a", "b"]]
    keys = [bytes(r[0]) for r in df.select(common.text_key(F.col("t"))).collect()]
    assert len(set(keys)) == 4 and all(len(k) == 16 for k in keys)


def test_let_computes_once(spark):
    df = spark.range(3)
    assert [r[0] for r in df.select(common.let(F.col("id") + 1, lambda x: x * x)).collect()] == [1, 4, 9]


def test_small_side(spark):
    table = spark.range(10)
    hint = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hint(common.small_side(table, 10)) and not hint(common.small_side(table, 9))


def test_stored_tables_can_be_dropped(spark):
    kept = list(scratch._written)
    scratch._written.clear()
    table = common.stored(spark.range(5), "five")
    assert table.count() == 5 and len(scratch._written) == 1
    common.drop_stored(spark)
    assert not scratch._written
    scratch._written.extend(kept)


def test_lookup_equals_a_left_join(spark, monkeypatch):
    monkeypatch.setattr(lookups, "HOT_ROWS", 50)
    rows = common.stored(spark.range(4000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'k' || id % 500 END AS key"), "rows")
    table = common.stored(rows.filter("key <> 'k1'").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least")), "table")
    want = rows.join(table, "key", "left").select("id", "key", "n", "least")
    got = lookups.lookup(rows, table, "key", "n")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_sieve_passes_all_of_its_keys(spark):
    keys = common.stored(spark.range(3000).selectExpr("'a' || id AS key"), "keys")
    rows = spark.range(30000).selectExpr("'a' || id AS key", "1 AS _word")
    marked = lookups.Sieve.of(keys, "key").marked(rows, "key", "maybe")
    assert marked.columns == ["key", "_word", "maybe"]
    hits = {r.key for r in marked.filter("maybe").collect()}
    assert {f"a{k}" for k in range(3000)} <= hits and len(hits) < 3000 + 0.05 * 27000
    left = lookups.without(rows.select("key"), keys, "key")
    assert sorted(r.key for r in left.collect()) == sorted(f"a{k}" for k in range(3000, 30000))
    none = keys.limit(0)
    assert lookups.without(rows.select("key"), common.stored(none, "none"), "key").count() == 30000
