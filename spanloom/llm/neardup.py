"""Operator 1, n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked if their sets have a
Jaccard similarity of ``threshold`` or more. Equal texts are combined first and
stand for all their copies.

1. Sketch: HASHES MinHash values of each text, in the tasks that read it; copies that
   a task meets again are passed over.
2. Candidates: BANDS bands of ROWS values each; a bucket holds the texts equal in
   one band. At similarity 0.8 a pair misses every band with probability 5e-8.
   Buckets with the same members are kept once (the earliest band's).
3. A bucket is cut by hash into blocks of about BLOCK texts, or of BLOCK_BYTES bytes of
   them if they are long, and each pair of blocks is one unit of work, so no task
   holds a bucket. A pair counts only in its earliest common band, hence once.
4. Pruning: MinHash values are compared in steps. A pair is dropped as soon as,
   under a uniform prior, the posterior probability that its similarity reaches
   the threshold falls below TOLERANCE.
5. Verification: a sieve of the candidates' keys picks their texts from the table as it
   is read, and pairs left are compared by their whole shingle sets (64-bit hashes of
   the shingles). A unit returns one row for each of its texts, with its
   number of links and the least text it is connected to in this unit; pairs
   themselves are never rows.
6. These rows are edges of a forest with the same components as all links.

Defined results. Null text counts as empty. Texts of one to four words have one
shingle, all their words; texts without words have none and are linked to nothing,
but equal ones share a class. A text of any length is compared whole; it fills a
block by itself. Null or repeated ids: each row has its class; the class id is the
least id that is not null, null if there is none. Of rows equal in id and class one
stays. Empty tables give empty results. Other columns are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanloom.llm.common import documents, stored, text_key, text_or_empty
from spanloom.llm.components import components
from spanloom.llm.lookups import Sieve, lookup, without

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BLOCK, BLOCK_BYTES, STEP, TOLERANCE = 1024, 16 << 20, 32, 1e-9
_WORDS_KEPT, _KEYS_KEPT = 200_000, 200_000


def shingles(text: str, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the text's shingles, with repeats; ``known`` holds the task's hashes of words."""
    ws = text.encode("utf-8", "surrogatepass").split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(known) > _WORDS_KEPT:
        known.clear()
    for w in set(ws):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    width = min(SHINGLE, len(ws))
    out = np.full(len(ws) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(ws) - width + 1 + k]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(1)
    return r.integers(0, 2**32, (HASHES, 1), dtype=np.uint32), r.integers(0, 2**31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """HASHES minima over the set, each under a permutation of its own."""
    b, a = permutations()
    low = hashes.astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        x = (low[None, at : at + 1024] ^ b) * a
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        np.minimum(best, x.min(axis=1), out=best)
    return best


@lru_cache(maxsize=8)
def fewest_equal(threshold: float) -> tuple[int, ...]:
    """After 32, 64, ... values: the least number of equal ones at which P(similarity >= threshold) is TOLERANCE or more.

    With a uniform prior that probability is P(Binomial(n + 1, threshold) <= equal).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < TOLERANCE and m < n:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches; a run may go over several batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


UNIT = ["bucket", "lo", "hi"]


def _candidates(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each unit of work, the texts with a pair left after pruning; bits tell with which later texts."""
    need = fewest_equal(threshold)
    rows: list[tuple] = []
    for unit in _groups(batches, UNIT):
        bucket, lo, hi = (unit.column(k)[0].as_py() for k in UNIT)
        band = bucket & (BANDS - 1)
        n = unit.num_rows
        if n < 2:
            continue
        keys = unit.column("key").to_pylist()
        sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint32).reshape(n, HASHES)
        block = unit.column("block").to_numpy()
        if lo == hi:
            left, right = np.triu_indices(n, 1)
        else:
            first, second = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
            left, right = np.repeat(first, len(second)), np.tile(second, len(first))
        kept = []
        for at in range(0, len(left), 8192):
            i, j = left[at : at + 8192], right[at : at + 8192]
            equal = np.zeros(len(i), np.int32)
            for k, least in enumerate(need):
                cols = slice(k * STEP, (k + 1) * STEP)
                equal += (sig[i, cols] == sig[j, cols]).sum(axis=1, dtype=np.int32)
                stay = equal >= least
                i, j, equal = i[stay], j[stay], equal[stay]
                if not len(i):
                    break
            if len(i):
                common = (sig[i] == sig[j]).reshape(-1, BANDS, ROWS).all(axis=2)
                own = common.argmax(axis=1) == band
                kept.append((i[own], j[own]))
        i = np.concatenate([x for x, _ in kept]) if kept else np.zeros(0, int)
        if not len(i):
            continue
        j = np.concatenate([x for _, x in kept])
        used = np.unique(np.concatenate([i, j]))
        bits = np.zeros((len(used), len(used)), bool)
        bits[np.searchsorted(used, i), np.searchsorted(used, j)] = True
        packed = np.packbits(bits, axis=1)
        rows += [(bucket, lo, hi, p, keys[x], packed[p].tobytes()) for p, x in enumerate(used.tolist())]
        if len(rows) >= 4096:
            yield _batch(rows, _CANDIDATE)
            rows = []
    if rows:
        yield _batch(rows, _CANDIDATE)


_CANDIDATE = pa.schema([("bucket", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("pos", pa.int32()), ("key", pa.binary()), ("bits", pa.binary())])
_LINKED = pa.schema([("key", pa.binary()), ("links", pa.int64()), ("root", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """For each unit of work, its linked texts: number of links, and the least text connected to it there."""
    rows: list[tuple] = []
    known: dict[bytes, int] = {}
    for unit in _groups(batches, UNIT):
        order = np.argsort(unit.column("pos").to_numpy())
        n = len(order)
        keys, texts, bits = (unit.column(k).to_pylist() for k in ("key", "text", "bits"))
        sets = [np.unique(shingles(texts[x], known)) for x in order]
        sizes = np.array([len(s) for s in sets])
        ends = np.cumsum(sizes)
        every, codes = np.unique(np.concatenate(sets), return_inverse=True)
        links, up = np.zeros(n, np.int64), list(range(n))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        has = np.zeros(len(every), bool)
        for p, x in enumerate(order.tolist()):
            partners = np.flatnonzero(np.unpackbits(np.frombuffer(bits[x], np.uint8), count=n))
            if not len(partners):
                continue
            own = codes[ends[p] - sizes[p] : ends[p]]
            has[own] = True
            if len(partners) * 4 < n:
                shared = np.array([np.count_nonzero(has[codes[ends[q] - sizes[q] : ends[q]]]) for q in partners])
            else:
                shared = np.add.reduceat(has[codes].astype(np.int64), ends - sizes)[partners]
            has[own] = False
            good = partners[shared >= threshold * (sizes[p] + sizes[partners] - shared) - 1e-9]
            links[p] += len(good)
            links[good] += 1
            for q in good.tolist():
                a, b = top(p), top(q)
                up[max(a, b)] = min(a, b)
        least: dict[int, bytes] = {}
        for p in np.flatnonzero(links).tolist():
            t = top(p)
            least[t] = min(least.get(t, keys[order[p]]), keys[order[p]])
        rows += [(keys[order[p]], int(links[p]), least[top(p)]) for p in np.flatnonzero(links).tolist()]
        if len(rows) >= 4096:
            yield _batch(rows, _LINKED)
            rows = []
    if rows:
        yield _batch(rows, _LINKED)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met: set[bytes] = set()
    known: dict[bytes, int] = {}
    for batch in batches:
        keys, sigs, sizes = [], [], []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            if key in met:
                continue
            if len(met) < _KEYS_KEPT:
                met.add(key)
            s = shingles(text.as_py(), known)
            if len(s):
                keys.append(key)
                sigs.append(minhash(s).tobytes())
                sizes.append(text.as_buffer().size)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(sizes, pa.int64())], names=["key", "sig", "bytes"])


def linked_texts(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(key, links, root) for each distinct text with links: their number and the least text of its component."""
    keyed = docs.select(text_key(F.col(text)).alias("key"), text_or_empty(F.col(text)).alias("text"))
    sketches = stored(keyed.mapInArrow(_sketches, "key binary, sig binary, bytes long").dropDuplicates(["key"]), "sketches")
    slot = lambda k: F.substring("sig", k * ROWS * 4 + 1, ROWS * 4)
    buckets = F.array(*[F.xxhash64(slot(k), F.lit(k)).bitwiseAND(F.lit(-BANDS)).bitwiseOR(F.lit(k)) for k in range(BANDS)])
    banded = sketches.select("key", "bytes", F.explode(buckets).alias("bucket"))
    same = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")]
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("bytes").alias("bytes"), *same).filter("m > 1")
    earliest = F.min(F.struct(F.col("bucket").bitwiseAND(F.lit(BANDS - 1)), "bucket"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    kept = stored(sizes.groupBy("m", "bytes", "x", "y").agg(earliest.alias("b")).select("b.bucket", blocks.alias("blocks")), "buckets")
    members = banded.select("key", "bucket").join(kept, "bucket")
    members = members.withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block")
    units = members.join(sketches.select("key", "sig"), "key").repartition(*UNIT).sortWithinPartitions(*UNIT)
    fields = "bucket long, lo int, hi int, pos int, key binary, bits binary"
    pairs = stored(units.mapInArrow(lambda b: _candidates(b, threshold), fields), "candidates")
    texts = Sieve.of(pairs, "key").marked(keyed, "key", "maybe").filter("maybe").dropDuplicates(["key"]).select("key", "text")
    units = pairs.join(texts, "key").repartition(*UNIT).sortWithinPartitions(*UNIT)
    linked = stored(units.mapInArrow(lambda b: _verified(b, threshold), "key binary, links long, root binary"), "linked")
    roots = components(linked.select(F.col("key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "key")
    return linked.groupBy("key").agg(F.sum("links").alias("links")).join(roots, "key", "left").select("key", "links", F.coalesce("root", "key").alias("root"))


def _by_text(texts: DataFrame, linked: DataFrame) -> DataFrame:
    """For each key of ``texts`` (key, n, first): n, links, and first and size of its class.

    ``first`` is the least of a value over the rows of a text, ``n`` their number. Texts
    are combined before they meet their class, and a class with many texts is looked up.
    """
    texts = stored(texts.join(linked, "key", "left"), "texts")
    alone = texts.filter("root is null").select("key", "n", F.lit(0).cast("long").alias("links"), "first", F.col("n").alias("size"))
    joined = texts.filter("root is not null")
    of_class = stored(joined.groupBy("root").agg(F.min("first").alias("least"), F.sum("n").alias("size"), F.count("*").alias("texts")), "classes")
    found = lookup(joined, of_class, "root", "texts")
    return stored(alone.unionByName(found.select("key", "n", "links", F.col("least").alias("first"), "size")), "texts")


def classes(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links (other texts linked to this one) and class_size (documents) for each row of ``docs``."""
    linked = linked_texts(docs, threshold, text)
    rows = stored(docs.select(F.col(id).alias("doc_id"), text_key(F.col(text)).alias("key")), "rows")
    texts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    found = lookup(rows, _by_text(texts, linked), "key", "n")
    return found.select("doc_id", F.col("first").alias("class_id"), F.col("links").alias("n_links"), F.col("size").alias("class_size"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the least id stays.

    Rows are stored with a number; the numbers of those that go are found among ids and
    keys alone, so only rows that a sieve of these numbers passes are shuffled.
    """
    names = {c: f"_doc_{k}" for k, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(c).alias(n) for c, n in names.items()], text_key(F.col(text)).alias("key"), F.monotonically_increasing_id().alias("row"))
    whole = stored(whole, "documents")
    linked = linked_texts(whole.select(F.col(names[text]).alias("text")), threshold)
    rows = whole.select(F.col(names[id]).alias("id"), "key", "row")
    texts = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    gone = lookup(rows, _by_text(texts, linked), "key", "n").filter(F.col("row") != F.col("first.row")).select("row")
    kept = without(whole, stored(gone, "gone"), "row")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))
