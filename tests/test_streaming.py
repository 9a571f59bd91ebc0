"""Chains as a stream against the batch form, with late, odd and closed reads."""

import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import chains
from spanloom.sources import views
from spanloom.streaming.chains import islands_stream, replayed

FIELDS = "read long, contig string, contig_length long, s long, e long, rev boolean, ord long, line long, part long, length long, kind string"


def element(read, ord, s, contig="c", rev=False, length=10):
    return (read, contig, 5000, s, s + length, rev, ord, 0, 0, length, "a clashing name")


@pytest.fixture
def play(spark, tmp_path):
    """Plays batches of elements one after the other, the stream begun anew for each, and returns all rows given out."""

    def run(*batches, **options):
        at, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
        for rows in batches:
            spark.createDataFrame(rows, FIELDS).write.mode("append").parquet(at)
            stream = islands_stream(spark.readStream.schema(FIELDS).parquet(at), **options)
            stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((r["read"], r["kind"], r["ord"], r["place"], r["gap"], r["island"], r["n_late"]) for r in spark.read.schema(stream.schema).parquet(out).collect())

    return run


def test_state_goes_on_from_batch_to_batch(play):
    got = play([element(1, 2, 100), element(1, 1, 0), element(2, 1, 0)], [element(1, 3, 5000)], [element(1, 4, 5005), element(2, 2, 20, "d")])
    end = 2 * (5000 + chains.PENALTY) - chains.PENALTY - 10 - 30
    assert got == [
        (1, "element", 1, 0, None, 0, 0),
        (1, "element", 2, 1, 90, 0, 0),
        (1, "element", 3, 2, 4890, 1, 0),
        (1, "element", 4, 3, 0, 1, 0),
        (2, "element", 1, 0, None, 0, 0),
        (2, "element", 2, 1, end, 1, 0),
    ]


def test_late_elements_are_counted_and_change_nothing(play):
    got = play([element(1, 5, 0)], [element(1, 3, 9000), element(1, 4, 9000), element(1, 6, 20)], [element(1, 1, 0)], [element(1, 6, 20)])
    assert got == [
        (1, "element", 5, 0, None, 0, 0),
        (1, "element", 6, 1, 10, 0, 2),
        # an equal row is not late
        (1, "element", 6, 2, 0, 0, 3),
        (1, "late", 1, None, None, None, 3),
        (1, "late", 3, None, None, None, 1),
        (1, "late", 4, None, None, None, 2),
    ]


def test_rows_with_nulls_take_no_part(play):
    odd = [(None, *element(1, 1, 0)[1:]), (1, None, *element(1, 1, 0)[2:]), (1, "c", 5000, None, 5, False, 1, 0, 0, 5, None), (1, "c", 5000, 0, 5, None, 1, 0, 0, 5, None)]
    assert play(odd, [*odd, element(1, 2, 0)]) == [(1, "element", 2, 0, None, 0, 0)]


def test_many_reads_share_a_state(spark, tmp_path, play):
    """State rows grow with the buckets, not the reads; late, equal and new elements of many reads in one bucket are told apart."""
    first = [element(r, o, 10 * r + 3000 * o, "cd"[r % 2], rev=r % 3 == 0) for r in range(3000) for o in (2, 1)]
    then = [element(r, 2 - r % 2, 10 * r, "cd"[r % 2], rev=r % 3 == 0, length=9) for r in range(0, 3000, 5)] + [element(3000, 1, 0)]
    got = play(first, then, buckets=2)
    assert len(got) == len(first) + len(then)
    assert {x[0] for x in got if x[1] == "late"} == set(range(0, 3000, 5))
    assert [x for x in got if x[0] == 5] == [(5, "element", 1, 0, None, 0, 0), (5, "element", 2, 1, 2990, 1, 0), (5, "late", 1, None, None, None, 1)]
    assert [x for x in got if x[0] == 3000] == [(3000, "element", 1, 0, None, 0, 0)]

    at = str(tmp_path / "many")
    spark.createDataFrame(first, FIELDS).write.parquet(at)
    stream = islands_stream(spark.readStream.schema(FIELDS).parquet(at))
    q = stream.writeStream.format("memory").queryName("many_reads").option("checkpointLocation", str(tmp_path / "many-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == len(first)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 1024
    assert spark.table("many_reads").count() == len(first)


def test_replayed_equals_batch(spark, sf):
    rows = chains.of_quality(views.chain_elements(spark, sf), views.CHAIN_QUALITY)
    # one read holds a third of all rows
    rows = rows.withColumn("read", F.when(F.col("part") % 3 == 0, 1).otherwise(F.col("read")))
    got = replayed(rows, max_gap=300, rows_an_arrival=1000).drop("n_late")
    assert got.filter("kind <> 'element'").count() == 0
    columns = ["read", "ord", "line", "part", "place", "gap", "island"]
    one, two = (df.select(*[F.col(c).cast("long") for c in columns]) for df in (got, chains.islands(rows, max_gap=300)))
    assert one.count() == two.count() > 3000
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_replayed_of_no_rows(spark, sf):
    assert replayed(views.chain_elements(spark, sf).filter("false")).count() == 0


def test_silent_reads_are_closed(spark, tmp_path):
    at = str(tmp_path / "in")
    write = lambda *rows: spark.createDataFrame(rows, FIELDS).write.mode("append").parquet(at)
    write(element(1, 1, 0), element(1, 2, 4000), element(2, 1, 0))
    stream = islands_stream(spark.readStream.schema(FIELDS).parquet(at), timeout_ms=1000)
    q = stream.writeStream.format("memory").queryName("closed_reads").option("checkpointLocation", str(tmp_path / "state")).start()
    given = lambda what: sorted((r["read"], r["place"], r["island"], r["gap"]) for r in spark.table("closed_reads").filter(what).collect())

    def wait_for(n: int, what: str) -> list:
        until = time.time() + 60
        while len(given(what)) < n and time.time() < until:
            time.sleep(0.5)
        return given(what)

    try:
        assert wait_for(2, "kind = 'closed'") == [(1, 1, 1, None), (2, 0, 0, None)]
        write(element(1, 3, 4000))
        assert wait_for(1, "kind = 'element' and ord = 3") == [(1, 0, 0, None)]
    finally:
        q.stop()
