"""Readers and writers: round trips and records that are refused."""

import pytest
from pyspark.sql import functions as F

from spanloom.sources import formats
from spanloom.streaming.alignments import alignment_stream, coverage_by_target

LINES = ["r1\t90\t0\t50\t+\tt\t500\t10\t60\t40\t50\t60\ttp:A:P\tcm:i:7", "r2\t80\t5\t70\t-\tt\t500\t40\t99\t50\t60\t55\t", "r3\t70\t0\t60\t+\tu\t400\t0\t60\t50\t60\t3"]


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_alignments(spark, put, tmp_path):
    path = put("a.tsv", "\n".join(LINES) + "\n")
    rows = formats.read_alignments(spark, path)
    assert [(r.query, r.is_reverse, r.mapq, r.minimizers) for r in rows.orderBy("query").collect()] == [("r1", False, 60, 7), ("r2", True, 55, None), ("r3", False, 3, None)]
    assert formats.read_alignments(spark, path, 50).count() == 2
    formats.write_alignments(rows, str(tmp_path / "out"))
    assert sorted(map(tuple, formats.read_alignments(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, rows.collect()))
    assert formats.chain_rows(rows).count() == 1 and set(formats.intervals(rows).columns) == {"target", "query", "s", "e", "rev", "mapq"}
    names = spark.createDataFrame([("r2",)], "name string")
    assert [r.value for r in formats.alignment_lines(spark, path, names).collect()] == [LINES[1]]
    for bad in ("r1\t90\t0", LINES[0].replace("+", "?")):
        with pytest.raises(Exception, match="alignment"):
            formats.read_alignments(spark, put("bad.tsv", bad)).collect()


def test_adjacency(spark, put, tmp_path):
    rows = formats.read_adjacency(spark, put("e.csv", "x,y,same\nb,a,Yes\na,c,No,Yes\nc,d,Yes,No,Yes\n"))
    assert sorted(map(tuple, rows.collect())) == [("a", "b", False, True, False, False, False), ("a", "c", True, True, True, False, False), ("c", "d", False, True, False, True, False)]
    formats.write_edges(rows, str(tmp_path / "edges"))
    assert spark.read.csv(str(tmp_path / "edges"), header=True).count() == 3
    assert formats.read_adjacency(spark, put("h.csv", "b,a,Yes\n"), header=False).count() == 1


def test_adjacency_of_numbers_of_unlike_length(spark, put):
    """1,000,000 comes behind 999,999 as a number, before it as text."""
    path = put("n.csv", "x,y,same\n1000000,999999,Yes\n7,10,No\n")
    pairs = lambda **kw: sorted((r.n0, r.n1) for r in formats.read_adjacency(spark, path, **kw).collect())
    assert pairs(numeric=True) == [("7", "10"), ("999999", "1000000")]
    assert pairs() == [("10", "7"), ("1000000", "999999")]


def test_adjacency_of_numbers_as_registered(spark, tmp_path):
    """Parts on both sides of 900,000, whose names have six digits and seven."""
    import duckdb

    from spanloom.plans import records

    duckdb.sql(f"""COPY (SELECT * FROM (VALUES (1, 899999, 'A', 0.05, 30.0), (1, 900001, 'R', 0.05, 30.0), (1, 1, 'A', 0.01, 1.0)) v(l_orderkey, l_partkey, l_returnflag, l_discount, l_quantity)) TO '{tmp_path}/lineitem.parquet'""")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    mine = records.adjacency_csv(spark, str(tmp_path))
    assert sorted(map(tuple, mine.collect())) == sorted(con.sql(records.ORACLE["adjacency_csv"]).fetchall())



def test_sequences(spark, put, tmp_path):
    reads = formats.read_fasta(spark, put("s.fasta", ">one first\nACGT\nAC\n>two\n\n>three\nTTT"))
    assert sorted(map(tuple, reads.collect())) == [("one", "ACGTAC"), ("three", "TTT"), ("two", "")]
    formats.write_fasta(reads, str(tmp_path / "f"))
    assert sorted(map(tuple, formats.read_fasta(spark, str(tmp_path / "f")).collect())) == sorted(map(tuple, reads.collect()))
    assert {r.name: r.length for r in formats.fasta_index(reads).collect()} == {"one": 6, "two": 0, "three": 3}
    with pytest.raises(Exception, match="twice"):
        formats.fasta_index(reads.union(reads)).collect()
    q = formats.read_fastq(spark, put("s.fastq", "@one x\nACGT\n+\nII@I\n@two\nAC\n+two\n!!\n"))
    assert sorted(map(tuple, q.collect())) == [("one", "ACGT", "II@I"), ("two", "AC", "!!")]
    formats.write_fastq(q, str(tmp_path / "q"))
    assert sorted(map(tuple, formats.read_fastq(spark, str(tmp_path / "q")).collect())) == sorted(map(tuple, q.collect()))
    with pytest.raises(Exception, match="FASTQ"):
        formats.read_fastq(spark, put("cut.fastq", "@one\nACGT\n+\n")).collect()


@pytest.mark.parametrize("block", ["37", "64", "1000000"])
def test_fastq_with_at_signs_in_any_block(spark, put, block):
    records = [(f"r{k}", "ACGT" * (k % 5 + 1), (("@" if k % 3 else "I") + "@!+5"[k % 5 :] + "#" * 20)[: 4 * (k % 5 + 1)]) for k in range(60)]
    path = put("at.fastq", "".join(f"@{n} x\n{s}\n+\n{q}\n" for n, s, q in records))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert sorted(map(tuple, formats.read_fastq(spark, path).collect())) == sorted(records)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("block", ["5", "11", "1000000"])
def test_fastq_of_single_letters_and_blank_lines(spark, put, block):
    """Lines are told apart by their number alone, wherever a block begins; a file in blocks equals one block."""
    records = [("a", "A", "@"), ("b", "", ""), ("@c", "C", "+"), ("d", "G", "@"), ("e", "ACGT", "@+@+"), ("f", "T", "@")]
    text = "".join(f"@{n}\n{s}\n+{n}\n{q}\n" for n, s, q in records)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for tail in ("", "\n\n"):
            assert sorted(map(tuple, formats.read_fastq(spark, put("one.fastq", text + tail)).collect())) == sorted(records)
        assert sorted(map(tuple, formats.read_fastq(spark, put("crlf.fastq", text.replace("\n", "\r\n"))).collect())) == sorted(records)
        lines, _ = formats.numbered_lines(spark, put("n.txt", "x\n" * 30))
        assert sorted(r.line for r in lines.collect()) == list(range(30))
        assert formats.read_fastq(spark, put("none.fastq", "")).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_that_are_refused(spark, put):
    for text in ("@one\nACGT\n+\nIII\n", "@one\nACGT\n+\n@III\n@junk\n", "@one\nACGT\n", "@one\nACGT\n+\n@III\n@two\nAC\n+\n"):
        with pytest.raises(Exception, match="FASTQ"):
            formats.read_fastq(spark, put("bad.fastq", text)).collect()
    for text in ("no header\n>one\nAC\n", "ACGT\n"):
        with pytest.raises(Exception, match="FASTA"):
            formats.read_fasta(spark, put("bad.fasta", text)).collect()
    assert formats.read_fasta(spark, put("empty.fasta", "")).count() == 0


def test_labels_and_info(spark, put, tmp_path):
    info = formats.read_alignment_info(spark, put("i.csv", "a,b,f,m,d,s,t,overlap\n1,2,0.5,10,3,4,5,0\n1,3,0.5,10,3,4,5,7\n"))
    assert sorted((r.b, r.label) for r in info.collect()) == [(2, False), (3, True)]
    formats.write_labelled(info.select("a", "b"), F.col("b") == 3, str(tmp_path / "l"))
    assert (tmp_path / "l" / "label=true").exists() and sorted((r.b, r.label) for r in formats.read_labelled(spark, str(tmp_path / "l")).collect()) == [(2, False), (3, True)]


def test_tables(spark, put):
    assert [(r.name, r.is_reverse) for r in formats.read_sam(spark, put("x.sam", "@HD\tVN\nr\t16\tt\t5\t60\t4M\n")).collect()] == [("r", True)]
    assert [r.name for r in formats.read_phases(spark, put("p.csv", "o,n,c,p\n0-0,a,1,0\n1-0,b,,\n")).collect()] == ["a"]
    assert [r.is_palindromic for r in formats.read_read_summary(spark, put("r.csv", "Id,Name,Palindromic\n1,a,Yes\n")).collect()] == [True]
    assert sorted(r.name for r in formats.read_names(spark, put("n.txt", "b\n\na\nb\n")).collect()) == ["a", "b"]
    assert [r.length for r in formats.read_lengths(spark, put("l.txt", "12\n")).collect()] == [12]
    assert [tuple(r) for r in formats.read_alignment_files(spark, put("3_4_1.csv", "k,i,j,x,y\n9,1,2,30,40\n")).collect()] == [("3", "4", False, 30, 40)]


def test_alignment_folders(spark, tmp_path):
    rows = [("r1", "r2", c, 5, 1, 2, k, k + 1) for k in range(5) for c in (True, False)] + [("r3", "r1", True, 5, 1, 2, 9, 9)]
    formats.write_alignment_files(spark.createDataFrame(rows, "a string, b string, is_cross boolean, kmer long, ordinal_a long, ordinal_b long, x long, y long"), str(tmp_path / "al"))
    assert sorted(f.name for f in (tmp_path / "al").glob("*.csv")) == ["r1_r2_0.csv", "r1_r2_1.csv", "r3_r1_0.csv"]
    assert sorted(map(tuple, formats.read_alignment_files(spark, str(tmp_path / "al")).collect())) == sorted((a, b, c, x, y) for a, b, c, _, _, _, x, y in rows)
    (tmp_path / "al" / "r8_r7_1_x.csv").write_text("k,i,j,x,y\n")
    assert sorted(map(tuple, formats.read_alignment_file_edges(spark, str(tmp_path / "al")).collect())) == [("r1", "r2", False), ("r1", "r2", True), ("r1", "r3", True), ("r7", "r8", False)]
    (tmp_path / "al" / "r2_r1_0.csv").write_text("k,i,j,x,y\n")
    with pytest.raises(Exception, match="fewer edges"):
        formats.read_alignment_file_edges(spark, str(tmp_path / "al")).collect()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "a_b_2.csv").write_text("k,i,j,x,y\n1,1,1,1,1\n")
    for read in (formats.read_alignment_file_edges, formats.read_alignment_files):
        with pytest.raises(Exception, match="neither 0 nor 1"):
            read(spark, str(tmp_path / "other")).collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text("\n".join(LINES) + "\n")
    q = coverage_by_target(alignment_stream(spark, str(tmp_path / "in"), 50)).writeStream.format("memory").queryName("coverage").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("coverage").collect()] == [("t", 2, 109)]
