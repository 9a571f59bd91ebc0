"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from spanloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows_of(spark, sf, con, query, sql):
    df = query(spark, sf)
    columns = sorted(df.columns)
    r = con.sql(sql)
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=repr), sorted((tuple(x[k] for k in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, sf, con, name):
    mine, theirs = rows_of(spark, sf, con, registry.QUERIES[name], registry.ORACLE[name])
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).columns == ["n0", "n1", "is_cross"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_without_sql_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_chains_of_the_registered_pairs(spark, sf, con):
    """Chains hold matches of their pair in rising order, and the score is what their lengths, changes of diagonal and openings give.

    A chain that begins far from both borders begins with the cost of both whole sequences instead of its first match.
    """
    from itertools import groupby

    from spanloom.sources.views import READS

    size = dict(con.sql(f"WITH {READS} SELECT read, length(sequence) FROM reads").fetchall())
    matches = {tuple(r) for r in registry.QUERIES["exact_matches"](spark, sf).collect()}
    rows = sorted(registry.QUERIES["dag_chain"](spark, sf).collect(), key=lambda r: (r.a, r.b, r.step))
    for _, own in groupby(rows, key=lambda r: (r.a, r.b)):
        own = list(own)
        assert all((r.a, r.b, r.x, r.y, r.len) in matches for r in own) and [r.step for r in own] == list(range(len(own)))
        gaps = [abs((q.x - q.y) - (p.x - p.y)) for p, q in zip(own, own[1:])]
        far = own[0].x > 100 and own[0].y > 100
        begin = -1 - size[own[0].a] - size[own[0].b] if far else own[0].len
        assert own[0].score == begin + sum(r.len for r in own[1:]) - sum(g + 1 for g in gaps if g)


def test_alignments_of_the_registered_pairs(spark, sf, con):
    from spanloom.operators.align import cigar_cost, wavefront
    import re

    pairs = con.sql("SELECT * FROM (SELECT p_partkey, p_name, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS two FROM part) WHERE two IS NOT NULL").fetchall()
    got = {r.p_partkey: (r.cost, r.cigar) for r in registry.QUERIES["gap_affine_align"](spark, sf).collect()}
    assert set(got) == {k for k, _, _ in pairs}
    for k, one, two in pairs:
        cost, cigar = got[k]
        ops = [(o, int(n)) for n, o in re.findall(r"(\d+)([=XID])", cigar)]
        assert (cost, cigar) == wavefront(one, two) and cigar_cost(ops) == cost
        assert sum(n for o, n in ops if o in "=XI") == len(one) and sum(n for o, n in ops if o in "=XD") == len(two)


def test_confusion_of_the_registered_fit(spark, sf, con):
    rows = registry.QUERIES["overlap_classifier"](spark, sf).collect()
    per = {a: sum(r.n for r in rows if r.actual == a) for a in (0, 1)}
    whole = dict(con.sql("SELECT CAST(l_returnflag = 'R' AS INT), count(*) FROM lineitem GROUP BY 1").fetchall())
    assert all(0.3 * whole[a] < per[a] < 0.5 * whole[a] for a in (0, 1)) and {r.predicted for r in rows} <= {0, 1}
