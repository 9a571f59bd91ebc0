"""Exact matches of sequence pairs: k-mer seeds joined to maximal matches along diagonals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.scalars import is_marker, kmers, match_stop, reverse_complement
from spanloom.functions.scratch import stored
from spanloom.operators.blocks import hot_keys, two_sided


def positions(reads: DataFrame, k: int) -> DataFrame:
    """read, pos, kmer of every k-mer."""
    return reads.select("read", F.posexplode(kmers(F.col("sequence"), k)).alias("pos", "kmer")).filter("kmer is not null")


def markers(reads: DataFrame, k: int, density: float) -> DataFrame:
    return positions(reads, k).filter(is_marker(F.col("kmer"), density))


def seeds(one: str, two: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and length of the maximal matches of k letters ACGT or more between two sequences.

    A match begins with a common k-mer behind two different letters, and ends with one
    before two different letters. Both are found without the k-mers between: the second
    sequence's places are sorted by k-mer and neighbouring letter, and of a k-mer's places
    those with the same neighbour are left out. So the work goes with the letters and the
    matches, also where both sequences repeat themselves. In the order of diagonal and
    place, the n-th beginning and the n-th end belong together.
    """
    letters = [np.frombuffer(t.encode("ascii", "replace"), np.uint8) for t in (one, two)]
    (xc, xg), (yc, yg) = (_codes(t, k) for t in letters)
    xs, ys = _shared(xc, np.flatnonzero(xg), yc, np.flatnonzero(yg))
    kinds = np.unique(yc[ys])
    if not len(kinds) or not len(xs):
        return (np.zeros(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(kinds, xc[xs]), len(kinds) - 1)
    known = kinds[at] == xc[xs]
    xs, xk, yk = xs[known], at[known], np.searchsorted(kinds, yc[ys])
    pad = [np.concatenate([[fill], _DIGITS[t], [fill]]) for t, fill in zip(letters, (4, 5))]
    found = []
    for shift in (0, k + 1):
        xn, yn = pad[0][xs + shift], pad[1][ys + shift]
        keys = yk * 8 + yn
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        low, high = np.searchsorted(keys, xk * 8), np.searchsorted(keys, xk * 8 + 8)
        # letters beyond the sequence's ends, and others than ACGT, differ from all
        skip = np.where(xn < 4, xn, 7)
        same, behind = np.searchsorted(keys, xk * 8 + skip), np.searchsorted(keys, xk * 8 + skip + 1)
        x = np.concatenate([np.repeat(xs, same - low), np.repeat(xs, high - behind)])
        found.append((x, ys[order[np.concatenate([_ranges(low, same), _ranges(behind, high)])]]))
    (bx, by), (ex, ey) = found
    first, last = np.lexsort((bx, bx - by)), np.lexsort((ex, ex - ey))
    return bx[first], by[first], ex[last] - bx[first] + k


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The numbers from each ``low`` up to its ``high``, one range after the other."""
    many = high - low
    return np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)


#: The code of each letter's byte; 6 stands for all others.
_DIGITS = np.full(256, 6, np.int64)
_DIGITS[[ord(c) for c in "ACGT"]] = range(4)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The 2-bit code of every k-mer, and whether it has letters ACGT only."""
    n = len(letters) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    d = _DIGITS[letters]
    # codes of 1, 2, 4... letters, put together as the binary digits of k say
    part, size, code, done = d & 3, 1, np.zeros(len(d) + 1, np.int64), 0
    while True:
        if k & size:
            m = len(d) - done - size + 1
            code, done = code[:m] * 4**size + part[done : done + m], done + size
        if done == k:
            break
        part, size = part[:-size] * 4**size + part[size:], 2 * size
    others = np.concatenate([[0], np.cumsum(d > 3)])
    return code, others[k:] == others[:-k]


def _shared(xc: np.ndarray, xs: np.ndarray, yc: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without most of the places ``xs`` and ``ys`` whose codes ``xc`` and ``yc`` do not stand on the other side, told by a table of hashes; no others are lost."""
    bits = np.uint64(64 - max(10, (32 * max(len(xs), len(ys))).bit_length()))
    hx, hy = ((c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> bits for c in (xc[xs], yc[ys]))
    for _ in range(2):
        seen = np.zeros(1 << int(64 - bits), bool)
        seen[hy] = True
        kept = seen[hx]
        xs, hx = xs[kept], hx[kept]
        xs, hx, ys, hy = ys, hy, xs, hx
    return xs, ys


def spelled(sequence: str, k: int, piece: int = 1 << 20) -> Iterator[bytes]:
    """The k-mers of a sequence decoded from their codes, comma-joined, in pieces of at most ``piece`` k-mers; those with other letters than ACGT are left out."""
    letters, comma = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8), b""
    for at in range(0, len(letters), piece):
        code, good = _codes(letters[at : at + piece + k - 1], k)
        code = code[good]
        if len(code):
            text = np.full((len(code), k + 1), ord(","), np.uint8)
            for j in range(k):
                text[:, j] = _LETTERS[(code >> 2 * (k - 1 - j)) & 3]
            yield comma + text.tobytes()[:-1]
            comma = b","


def spelled_digests(reads: DataFrame, k: int) -> DataFrame:
    """read and the MD5 of its ``spelled`` k-mers (a null sequence has none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for t in batch.column("sequence"):
                md5 = hashlib.md5()
                for part in spelled(t.as_py() or "", k):
                    md5.update(part)
                digests.append(md5.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("read"), pa.array(digests, pa.string())], names=["read", "digest"])

    return reads.select("read", "sequence").mapInArrow(run, f"read {reads.schema['read'].dataType.simpleString()}, digest string")


#: Columns of a match, and rows that are given out at once.
MATCH, ROWS = ["a", "b", "x", "y", "len"], 100_000


def _of_pair(a: int, b: int, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.full(len(x), a, np.int64), np.full(len(x), b, np.int64), x, y, n


def _batches(found: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of about ROWS rows, at most, of the columns that come one group after the other."""
    waiting, size = [], 0
    merged = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*waiting)], names=names)
    for columns in found:
        for at in range(0, len(columns[0]), ROWS):
            waiting.append([c[at : at + ROWS] for c in columns])
            size += len(waiting[-1][0])
            if size >= ROWS:
                yield merged()
                waiting, size = [], 0
    if waiting:
        yield merged()


def exact_matches(pairs: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Maximal exact matches of k letters (31 at most) or more of each pair (a, b): a, b, x, y, len.

    Each pair's two sequences meet in one row, so what is shuffled are sequences, not
    k-mers, and a k-mer that many reads share makes no group. Pairs take far longer than
    their bytes tell, so they are dealt over all shuffle partitions and not put together again.
    """
    side = lambda name, text: reads.select(F.col("read").alias(name), F.col("sequence").alias(text))
    both = pairs.select("a", "b").join(side("a", "one"), "a").join(side("b", "two"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            found = (_of_pair(a[r], b[r], *seeds(one.as_py() or "", two.as_py() or "", k)) for r, (one, two) in enumerate(zip(batch.column("one"), batch.column("two"))))
            yield from _batches(found, MATCH)

    parts = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.select("a", "b", "one", "two").repartition(parts, "a", "b").mapInArrow(run, "a long, b long, x long, y long, len long")


def minimizers(letters: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and codes of the k-mers that are the least, in a hashed order, of some ``window`` of them; the leftmost of equal ones."""
    code, good = _codes(letters, k)
    if len(code) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # an odd multiplier mixes the order of the codes; k-mers with other letters than ACGT come last
    h = (code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1)
    h[~good] = np.uint64(1 << 63)
    # the least of 1, 2, 4... k-mers and its place, the left one of equals; two that overlap make a window
    least, at, size = h, np.arange(len(h)), 1
    while size < window:
        step = min(size, window - size)
        right = least[step:] < least[:-step]
        least, at, size = np.where(right, least[step:], least[:-step]), np.where(right, at[step:], at[:-step]), size + step
    # places never fall from one window to the next
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    at = at[good[at]]
    return at, code[at]


def _flanks(letters: np.ndarray, at: np.ndarray, k: int, n: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` letters before and behind the k-mers ``at``, the nearest in the lowest of three bits each; ``fill`` stands for other letters than ACGT and none."""
    d = np.concatenate([np.full(n, fill), np.where(_DIGITS[letters] > 3, fill, _DIGITS[letters]), np.full(n, fill)])
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for j in range(n):
        left |= d[at + n - 1 - j] << 3 * j
        right |= d[at + n + k + j] << 3 * j
    return left, right


#: Letters beside a seed that are held against each other before sequences are; three bits each in a long.
FLANK = 20


def sampled(reads: DataFrame, least: int, k: int, fill: int) -> DataFrame:
    """read, pos, kmer of the minimizers of windows of ``least - k + 1`` k-mers, with the letters on their left and right (``_flanks``)."""
    n = min(FLANK, least - k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def places(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for read, t in zip(batch.column("read").to_pylist(), batch.column("sequence")):
                letters = np.frombuffer((t.as_py() or "").encode("ascii", "replace"), np.uint8)
                at, code = minimizers(letters, k, least - k + 1)
                yield np.full(len(at), read, np.int64), at.astype(np.int64), code, *_flanks(letters, at, k, n, fill)

        for batch in batches:
            yield from _batches(places(batch), ["read", "pos", "kmer", "left", "right"])

    return reads.select(F.col("read").cast("long").alias("read"), "sequence").filter("read is not null").mapInArrow(run, "read long, pos long, kmer long, left long, right long")


def _long_enough(n: int) -> Column:
    """Whether the letters that agree on both sides of a seed, ``n`` of each being known, are ``n`` or more."""
    same = lambda side: sum(((F.col(f"{side}_a").bitwiseXOR(F.col(f"{side}_b"))).bitwiseAND(F.lit((1 << 3 * j) - 1)) == 0).cast("int") for j in range(1, n + 1))
    return same("left") + same("right") >= n


def extended(one: str, two: str, xs: np.ndarray, ys: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The maximal matches of ``least`` letters ACGT or more on which the seeds (xs, ys) lie, each once: x, y, len."""
    a, b = (_DIGITS[np.frombuffer(t.encode("ascii", "replace"), np.uint8)] for t in (one, two))
    out = []
    order = np.lexsort((xs, xs - ys))
    for d, group in groupby(zip((xs - ys)[order].tolist(), xs[order].tolist()), key=lambda r: r[0]):
        low, high = max(0, d), min(len(a), len(b) + d)
        differ = np.flatnonzero((a[low:high] != b[low - d : high - d]) | (a[low:high] > 3)) + low
        done = -1
        for _, x in group:
            if x >= done:
                n = np.searchsorted(differ, x)
                start, done = (int(differ[n - 1]) + 1 if n else low), (int(differ[n]) if n < len(differ) else high)
                if done - start >= least:
                    out.append((start, start - d, done - start))
    return out


#: Seeds of a pair of sequences that are handed on in one row.
SEEDS = 100_000


def against_references(reads: DataFrame, references: DataFrame, least: int, k: int, bound: int = 2000) -> DataFrame:
    """Maximal exact matches of ``least`` letters or more of every read with every reference: a (read), b (reference), x, y, len.

    Any match of ``least`` letters holds a whole window of ``least - k + 1`` k-mers, and
    its least k-mer is sampled in both sequences, so joining the samples finds every match.
    Samples bring the letters beside them along, so those that lie on no such match, most
    of them by far, go before any sequence is fetched. A k-mer that stands at more than ``bound`` places is joined in blocks. Of the seeds on
    a stretch of ``least`` letters of a diagonal the first and the last are kept, which lie on
    all matches there; a pair meets its two sequences with about SEEDS of its seeds a row,
    dealt by diagonal, and each run of equal letters is followed once. Rows without an id
    take no part.
    """
    left, right = stored(sampled(reads, least, k, 5), "read-seeds"), stored(sampled(references, least, k, 6), "reference-seeds")
    met = (side.withColumnsRenamed({"read": c, "pos": at, "left": f"left_{c}", "right": f"right_{c}"}) for side, c, at in ((left, "a", "x"), (right, "b", "y")))
    hit = two_sided(*met, ["kmer"], bound)
    if 0 < least - k <= FLANK:
        hit = hit.filter(_long_enough(least - k))
    # a match longer than a stretch is reached from any of its seeds
    stretch = F.floor(F.col("x") / least)
    hit = hit.groupBy("a", "b", (F.col("x") - F.col("y")).alias("d"), stretch.alias("stretch")).agg(F.min("x").alias("low"), F.max("x").alias("high"))
    # a stretch may hold the end of one match and the beginning of the next: its first and last seed lie on both
    seed = F.explode(F.array_distinct(F.array("low", "high"))).alias("x")
    hit = stored(hit.select("a", "b", "d", seed), "seeds")
    many = hot_keys(hit, ["a", "b"], SEEDS)
    hit = hit.withColumn("part", F.lit(0)) if many is None else hit.join(many, ["a", "b"], "left").withColumn("part", F.pmod("d", F.ceil(F.coalesce("_n", F.lit(1)) / SEEDS)))
    grouped = hit.groupBy("a", "b", "part").agg(F.collect_list("x").alias("xs"), F.collect_list(F.col("x") - F.col("d")).alias("ys"))
    side = lambda df, name, text: df.select(F.col("read").cast("long").alias(name), F.col("sequence").alias(text))
    rows = grouped.join(side(reads, "a", "one"), "a").join(side(references, "b", "two"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
            for r in range(batch.num_rows):
                a, b, one, two = (batch.column(c)[r].as_py() for c in ("a", "b", "one", "two"))
                xs, ys = (batch.column(c)[r].values.to_numpy() for c in ("xs", "ys"))
                got = np.array(extended(one, two, xs, ys, least), np.int64).reshape(-1, 3)
                yield _of_pair(a, b, *got.T)

        for batch in batches:
            yield from _batches(found(batch), MATCH)

    return rows.select("a", "b", "one", "two", "xs", "ys").mapInArrow(run, "a long, b long, x long, y long, len long")


def reversed_matches(pairs: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """Matches with the second read's reverse complement, in places of that read as it stands: y is where the match's last letter falls."""
    turned = reads.select((-F.col("read") - 1).alias("read"), reverse_complement(F.col("sequence")).alias("sequence")).filter("sequence is not null")
    found = exact_matches(pairs.select("a", (-F.col("b") - 1).alias("b")), reads.union(turned), k).withColumn("b", -F.col("b") - 1)
    sizes = reads.select(F.col("read").alias("b"), F.length("sequence").alias("_size"))
    return found.join(sizes, "b").select("a", "b", "x", (F.col("_size") - F.col("y") - F.col("len")).alias("y"), "len")


def unique_matches(matches: DataFrame, in_both: bool) -> DataFrame:
    """Matches whose letters stand once in the first sequence and, if ``in_both``, once in the second.

    The letters stand once more in a sequence exactly if another match of the pair
    covers the same letters of the other sequence.
    """
    for c in ("y", "x") if in_both else ("y",):
        end = F.col(c) + F.col("len")
        by = Window.partitionBy("a", "b")
        wider = by.orderBy(c, end.desc()).rowsBetween(Window.unboundedPreceding, -1)
        covered = F.coalesce(F.max(end).over(wider) >= end, F.lit(False)) | (F.count("*").over(Window.partitionBy("a", "b", c, "len")) > 1)
        matches = matches.withColumn(f"_covered_{c}", covered)
    keep = ~F.col("_covered_y") & (~F.col("_covered_x") if in_both else F.lit(True))
    return matches.filter(keep).select("a", "b", "x", "y", "len")


def merged_diagonals(matches: DataFrame) -> DataFrame:
    """a, b, diagonal, start, stop: on each diagonal x - y the closed stretches of antidiagonals [x + y, x + y + len - 1], those that touch made one."""
    rows = matches.select("a", "b", (F.col("x") - F.col("y")).alias("diagonal"), (F.col("x") + F.col("y")).alias("start"), match_stop(F.col("x") + F.col("y"), F.col("len")).alias("stop"))
    w = Window.partitionBy("a", "b", "diagonal").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= before + 1, 0).otherwise(1)).over(w)
    return rows.withColumn("island", island).groupBy("a", "b", "diagonal", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def in_boxes(merged: DataFrame, boxes: DataFrame, reach: int) -> DataFrame:
    """Merged stretches that meet the box of ``reach`` behind each point (boxes: a, b, x, y), with the point and the stretch's own start.

    From the box's upper edge (x + t, y) and its left edge (x, y + t) a diagonal is
    searched over reach + 1 - t antidiagonals. Points and stretches lie in tiles of diagonals
    and antidiagonals about as wide as a box, so a point is repeated four times at most and a
    stretch once for each tile on its way; a pair counts in the tile where both begin to meet.
    """
    wide, long = 2 * reach + 1, 2 * reach + 2
    tiles = lambda low, high, width: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    spots = boxes.select("a", "b", "x", "y", (F.col("x") - F.col("y")).alias("_d"), (F.col("x") + F.col("y")).alias("_s"))
    spots = spots.withColumn("_across", tiles(F.col("_d") - reach, F.col("_d") + reach, wide)).withColumn("_along", tiles(F.col("_s"), F.col("_s") + reach + 1, long))
    lines = merged.select("a", "b", "diagonal", "start", "stop", F.floor(F.col("diagonal") / wide).alias("_across"), tiles(F.col("start"), F.col("stop"), long).alias("_along"))
    off = F.abs(F.col("diagonal") - F.col("_d"))
    meet = (off <= reach) & (F.col("start") <= F.col("_s") + reach + 1) & (F.col("stop") >= F.col("_s") + off)
    hit = spots.join(lines, ["a", "b", "_across", "_along"]).filter(meet & (F.col("_along") == F.floor(F.greatest("start", "_s") / long)))
    return hit.select("a", "b", "x", "y", ((F.col("start") + F.col("diagonal")) / 2).cast("long").alias("at_x"), ((F.col("start") - F.col("diagonal")) / 2).cast("long").alias("at_y"), (F.col("stop") - F.col("start") + 1).alias("len"))


def rebased(points: DataFrame, order: str) -> DataFrame:
    """Each alignment's coordinates (a, b, x, y) less its first ones in ``order``; the axes are swapped if y is ahead in the first."""
    first = points.groupBy("a", "b").agg(F.min_by(F.struct("x", "y"), F.struct(order, "x", "y")).alias("f"))
    swap = F.col("f.y") > F.col("f.x")
    x, y = F.col("x") - F.col("f.x"), F.col("y") - F.col("f.y")
    return points.join(first, ["a", "b"]).select("a", "b", order, F.when(swap, y).otherwise(x).alias("x"), F.when(swap, x).otherwise(y).alias("y"))


def termini(matches: DataFrame, skip: int) -> DataFrame:
    """Start, end and end of scope of each match along the antidiagonals, with their place in the sweep: of those in one antidiagonal, starts, then ends, then removals."""
    d, a = (F.col("x") - F.col("y")).alias("diagonal"), F.col("x") + F.col("y")
    kinds = [F.struct(F.lit(k).alias("kind"), at.cast("long").alias("antidiagonal")) for k, at in enumerate((a, a + 2 * F.col("len"), a + 2 * F.col("len") + skip))]
    rows = matches.select("a", "b", d, "x", F.explode(F.array(*kinds)).alias("t")).select("a", "b", "diagonal", "x", "t.kind", "t.antidiagonal")
    w = Window.partitionBy("a", "b").orderBy("antidiagonal", "kind", "diagonal", "x")
    return rows.withColumn("place", (F.row_number().over(w) - 1).cast("long"))


def points(matches: DataFrame, step: int) -> DataFrame:
    """Places along each match, every ``step`` letters from its start."""
    shift = F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1, F.lit(step).cast("long"))).alias("shift")
    return matches.select("a", "b", "x", "y", shift).select("a", "b", (F.col("x") + F.col("shift")).alias("x"), (F.col("y") + F.col("shift")).alias("y"))


def heatmap(matches: DataFrame, cell: int) -> DataFrame:
    """The longest match in each cell of a pair's matrix."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long").alias(f"{c}_bin")
    return matches.groupBy("a", "b", at("x"), at("y")).agg(F.max("len").alias("longest"))


def log_heatmap(cells: DataFrame) -> DataFrame:
    """``heatmap`` cells with their shade from 0 to 1: log(longest + 1) over that of the pair's longest."""
    most = F.max("longest").over(Window.partitionBy("a", "b"))
    return cells.withColumn("shade", F.log(F.col("longest").cast("double") + 1) / F.log(most.cast("double") + 1))


def mean_position(matches: DataFrame, step: int) -> DataFrame:
    """For each pair the mean start on ``a``, a match counting once for each ``step`` letters begun."""
    n = F.ceil(F.col("len") / step)
    return matches.groupBy("a", "b").agg(F.expr("0").alias("_z"), (F.sum(F.col("x") * n) / F.sum(n)).cast("long").alias("position")).drop("_z")


def next_matches(matches: DataFrame, reach: int) -> DataFrame:
    """For each match the nearest one of its pair that begins behind its end in both sequences, at most ``reach`` away in each.

    Starts are dealt into bins of ``reach`` along one sequence; an end looks into its own bin and the next.
    """
    ends = matches.select("a", "b", "x", "y", (F.col("x") + F.col("len")).alias("xe"), (F.col("y") + F.col("len")).alias("ye"))
    own = F.floor(F.col("xe") / reach)
    ends = ends.withColumn("bin", F.explode(F.array(own, own + 1)))
    starts = matches.select("a", "b", F.col("x").alias("nx"), F.col("y").alias("ny"), F.floor(F.col("x") / reach).alias("bin"))
    near = ends.join(starts, ["a", "b", "bin"]).filter((F.col("nx") >= F.col("xe")) & (F.col("ny") >= F.col("ye")) & (F.col("nx") - F.col("xe") <= reach) & (F.col("ny") - F.col("ye") <= reach))
    order = F.struct((F.col("nx") - F.col("xe") + F.col("ny") - F.col("ye")).alias("d"), "nx", "ny")
    best = near.groupBy("a", "b", "x", "y").agg(F.min(order).alias("m"))
    return best.select("a", "b", "x", "y", F.col("m.nx").alias("next_x"), F.col("m.ny").alias("next_y"), F.col("m.d").alias("distance"))
