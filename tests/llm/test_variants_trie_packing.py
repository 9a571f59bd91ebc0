"""Operators 11 to 13 and later changes of others: brute force on small tables, and defined results for odd rows."""

import collections
import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pytest
import re
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, mixing, packing, prefix_trie, spelling
from spanloom.llm.common import stored

ODD = [(1, None), (None, "passwordes passwordes passwordas"), (2, ""), (3, "   \n\t "), (5, "one two three"), (5, "one two three"), (7, "Éclairs éclairs éclairs éclaire éclaire éclaire éclaire éclaire éclaire é😀 <|endoftext|> x"), (8, "straße STRASSE " * 4000)]
CLASHING = "key which form word n other root best near h doc run at row stock ids crcs tokens block sequence_id offset used share _n _class _rank path depth conv depths".split()


def test_variants_equal_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(spelling.OP11_SQL).select("word, form, root, n, n_near, form_n").fetchall()
    got = spelling.op11_spelling_variants(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    # every signature cut into groups of forms gives the same
    hot = spelling.variants(spark.read.parquet(f"{sf}/documents.parquet"), group=3)
    assert sorted(map(tuple, hot.collect()), key=repr) == sorted(want, key=repr)


def variants_of(rows):
    counts = collections.Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(lower)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    form, many = {}, {}
    for w in n:
        own = [v for v in n if near(w, v)]
        many[w] = len(own)
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def last(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], last(w), n[w], many[w], n[form[w]] if form[w] else None) for w in n), key=repr)


def test_variants_of_random_and_odd_rows(spark):
    r = random.Random(7)
    text = lambda k: " ".join("".join(r.choices("abÀ", k=r.choice([4, 5, 5, 6]))) for _ in range(k))
    rows = [*ODD, *[(k, text(60)) for k in range(30)], (9, "aaaaa " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    want = variants_of(rows)
    assert len(want) > 100 and sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] for w in want if w[1])
    for group in (5000, 10):
        assert sorted(map(tuple, spelling.variants(df, group=group).collect()), key=repr) == want
    assert spelling.variants(df.limit(0)).count() == 0


def test_signatures_meet_for_every_near_pair(spark):
    """PartEnum is exact: words one letter apart share a signature, and the first that leaves out their letters' parts is one of them."""
    r = random.Random(11)
    rows = []
    for _ in range(400):
        w = "".join(r.choices(spelling.LETTERS[:8] + "éÿ", k=r.randrange(5, 12)))
        k, c = r.randrange(len(w)), r.choice(spelling.LETTERS)
        rows.append((w, w[:k] + c + w[k + 1 :], w[k] + c) if r.random() < 0.5 else (w, w[:k] + w[k + 1 :], w[k]))
    df = spark.createDataFrame(rows, "a string, b string, letters string").filter("a <> b")
    for t in df.select(spelling.signatures(F.col("a")).alias("a"), spelling.signatures(F.col("b")).alias("b"), "letters").collect():
        k = spelling.owner(*t.letters)
        assert t.a[k] == t.b[k]


def trie_of(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda x: hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()[:16]
    own = {c: [x[2:] for x in sorted(t, key=lambda x: (x[0], x[1], digest(x)))] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - c % 5, [])[:h] + t[h:])
    members = collections.defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    out = []
    for node, m in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = sorted(c for c in m if len(whole[c]) == len(node))
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(x) == len(node) + 1 for x in below), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


NODE = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def test_trie_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.sql(prefix_trie.OP12_SQL).select(", ".join(NODE)).fetchall(), key=repr)
    assert sorted(map(tuple, prefix_trie.op12_prefix_trie(spark, sf).select(*NODE).collect()), key=repr) == want


def test_trie_of_odd_and_random_rows(spark):
    r = random.Random(3)
    rows = [(0, None, None, None), (0, 0, "user", "é"), (0, 0, "user", "é"), (None, 1, "user", "x"), (6, 0, None, "x"), (6, 1, "", "x"), (12, 0, "user", "y" * 50_000)]
    rows += [(c, d, r.choice(["user", "bot"]), r.choice(["a", "bé", ""])) for c in range(20, 90) for d in range(r.randrange(7))]
    rows += [(c, d, "user", str(d)) for c in (-7, 100, 105, 110, 400) for d in range(40 if c != 110 else 25)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in CLASHING})
    want = trie_of(rows)
    for stride in (1, 3, 32):
        assert sorted(map(tuple, prefix_trie.trie(prefix_trie.rebuilt(df), stride).select(*NODE).collect()), key=repr) == want
    assert prefix_trie.trie(prefix_trie.rebuilt(df.limit(0))).count() == 0
    plain = {x.conv_id: [y.bytes for y in x.path] for x in prefix_trie.paths(df).collect()}
    assert plain[12] == [50_000] and plain[0] == [0, 2, 2] and None not in plain


def test_ends_of_many_conversations_are_hashed_in_order(spark):
    convs = spark.range(30_000).selectExpr("id AS conv_id", f"cast(if(id % 3 = 0, array(struct(unhex('0A') AS d, 1L AS bytes)), array()) AS {prefix_trie.PATH}) AS path")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
        got = {len(x.path): (x.n, x.conv_id, x.ends_sha256) for x in prefix_trie.ended(convs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k in (0, 1):
        own = [c for c in range(30_000) if (c % 3 == 0) == bool(k)]
        assert got[k] == (len(own), own[0], hashlib.sha256(",".join(map(str, own)).encode()).hexdigest())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(packing.VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [packing.END], dtype="<u4")


def packed_right(rows, docs, library, length=packing.LENGTH):
    """Pieces hold every id once, sequences have no gap; returns the padding."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in rows:
        by[p.doc_id, p.doc_tokens].append(p)
        sequences[p.sequence_id].append(p)
    want = collections.Counter()
    for i, t in docs:
        ids = library(t)
        want[i, len(ids), ids.tobytes()] += 1
    for (i, n, data), many in want.items():
        own = sorted(by[i, n], key=lambda p: p.start)
        assert sum(p.length for p in own) == many * n
        ends = collections.Counter(p.start + p.length for p in own)
        starts = collections.Counter(p.start for p in own)
        assert starts.pop(0) == many == ends.pop(n) and starts == ends
        assert all(p.ids_crc32 == zlib.crc32(data[4 * p.start : 4 * (p.start + p.length)]) for p in own)
    assert len(rows) == sum(len(by[i, n]) for i, n, _ in want)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_packing_holds_every_id_once(spark, sf, library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert packed_right(packing.op13_packing(spark, sf).collect(), docs, library) == 0


def test_packing_of_odd_rows(spark, library):
    # equal ids with texts of equal length would be told apart by nothing here
    docs = [(i, t) for i, t in ODD] + [(100 + k, "word " * k) for k in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    for options in ({}, {"length": 64, "block": 50}, {"length": 256, "shares": (1 / 64, 1 / 2, 1)}):
        assert packed_right(packing.pack(df, **options).collect(), docs, library, options.get("length", packing.LENGTH)) == 0
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_needs_a_larger_share(spark, library):
    """Documents of a little more than half a sequence leave gaps that a small share cannot fill."""
    docs = [(k, "a " * 39) for k in range(64)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert packed_right(packing.pack(df, length=64).collect(), docs, library, 64) == 0


def test_patterns_hold_all_pieces():
    r = np.random.default_rng(5)
    for lengths in (1 + r.integers(0, 2048, 5000), np.minimum(2048, 1 + r.exponential(300, 5000).astype(int)), np.full(50, 1025), r.integers(600, 800, 4000), np.array([2048]), np.array([], dtype=int)):
        step = np.array([1 << max(0, int(x - 1).bit_length() - 6) for x in lengths], dtype=int)
        sizes, counts = np.unique(-(-lengths // step) * step if len(lengths) else lengths, return_counts=True)
        found = packing.patterns(sizes, counts)
        assert all(n > 0 and a @ sizes <= 2048 for a, n in found)
        assert (sum((n * a for a, n in found), np.zeros(len(sizes), dtype=int)) == counts).all()
    # three to a sequence, which only the right mixtures reach
    sizes, counts = np.array([600, 640, 704]), np.array([1000, 1000, 1000])
    assert sum(n for _, n in packing.patterns(sizes, counts)) <= 1005


def test_best_pattern_is_the_best():
    r = np.random.default_rng(2)
    for _ in range(30):
        sizes, prices = np.sort(r.choice(np.arange(3, 40), 5, replace=False)), r.random(5)
        best = np.zeros(81)
        for c in range(1, 81):
            best[c] = max([best[c - 1], *[best[c - s] + p for s, p in zip(sizes, prices) if s <= c]])
        got = packing.best_pattern(sizes, prices, 80)
        assert got @ sizes <= 80 and abs(got @ prices - best[80]) < 1e-9


def test_word_ids_equal_the_library(library):
    own = packing.WordBpe(packing.VOCABULARY)
    r = random.Random(9)
    odd = ["İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "é ñ ẛ̣", "don't we'll 'sx ''s I'M", "<|endoftext|> <|startoftext|>x", "\x1c\x1d\x85\xa0 a", "½²³ ٣৪ Ⅷ", "日本語テキスト 👍🏽", "x" * 300, ""]
    texts = odd + ["".join(r.choices(["a", "The", "'s", " ", "é", "É", "ß", "\n", "12", "--", "!", "Σ", "\x1f", "ﬁ", "́"], k=r.randrange(50))) for _ in range(1500)]
    for t in texts:
        assert own.encode(t) == library(t)[:-1].tobytes(), t


def test_long_pre_tokens_take_linear_time():
    coder, t = bpe.vocabulary(bpe.VOCABULARY), Tokenizer.from_file(bpe.VOCABULARY)
    r = random.Random(4)
    kinds = ["ab" * 150_000, "".join(r.choices("ACGT", k=300_000)), "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGH", k=300_000)), "".join(chr(0x4E00 + r.randrange(5000)) for _ in range(100_000))]
    for text in kinds:
        spent = []
        for part in (text[: len(text) // 2], text):
            began = time.process_time()
            got, _ = coder.encode(part)
            spent.append(time.process_time() - began)
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids
        assert spent[1] < 3 * spent[0] + 0.5


def test_weights_that_are_no_numbers_are_missing(spark):
    rows = [(k, "s" if k % 2 else "t", "one two three four five six seven", w) for k, w in enumerate([float("nan"), float("inf"), 0.0, -1.0, None, 0.5, 1.0, -float("inf")] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w double")
    got = mixing.mix(df, weight="w", keep=("w",)).collect()
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
    bare = {r.doc_id: r.taken for r in mixing.mix(df.withColumn("w", F.lit(float("nan"))), weight="w").collect()}
    assert bare == {r.doc_id: r.taken for r in mixing.mix(df).collect()}


def test_attach_equals_a_left_join(spark, monkeypatch):
    from spanloom.llm import lookups

    rows = stored(spark.range(3000).selectExpr("id", "struct(if(id % 3 = 0, null, 'k' || id % 50) AS s) AS k"), "rows")
    table = stored(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")), "table")
    want = {(r.id, r.least) for r in rows.selectExpr("id", "if(id % 3 = 0, 0, null) AS zero", "k").join(table, "k").select("id", "least").collect()}
    for most in (10, 50_000):
        monkeypatch.setattr(lookups, "MOST_HOT", most)
        got = {(r.id, r.least) for r in lookups.attach(rows, table, "k", "n").collect()}
        assert len(got) == 3000 and got == want
