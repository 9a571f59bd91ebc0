"""Operator 5, approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Coarse centroids and codebooks are fitted on at most SAMPLE vectors; both have a
size set by parameters, so tasks get them with their function. Every vector gets
its nearest cell and the codes of its residual. A query probes its nearest cells
until these hold a share of all vectors, which is calibrated: within the sample,
cells up to that share hold RECALL of the true neighbours of CALIBRATED vectors.
Data in clear clusters need few cells, data without structure most of them. Small
cells are packed into bins, large ones cut into several, so a bin holds MOST_BIN rows
at most. Queries are sent to the bins of their cells; a bin is shuffled once, and once
more for every further CHUNK of queries that it gets, so what is moved for a block of
MOST_BIN x CHUNK distances is one bin and one chunk. A task works on one bin and one
chunk with asymmetric distance tables. Each row carries the norm of its coding error, which
bounds how far its coded distance is off: the CANDIDATES rows that look nearest
give an exact distance of rank k, and every row whose lower bound is not above it
is reranked by its exact distance in double precision. So coding loses nothing of
the probed cells, whatever the number of near copies; a task returns k rows a query.

Defined results. Vectors that are null, zero, or hold null or non-finite
components take no part; nor do those of another dimension than the most frequent
one, to which no distance is defined. Rows are told apart by a number given when they
are stored: repeated ids stay separate rows, and a query is never its own neighbour.
Equal distances go to the smaller id; rows without an id are candidates and come last
among equals. With fewer candidates than asked for, all are returned; an empty table
gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from spanloom.functions.shipping import ship_package
from spanloom.llm.common import small_side, stored

SAMPLE, MOST_CELLS, PARTS, CODES = 20_000, 1024, 32, 256
RECALL, CALIBRATED, ENOUGH, CANDIDATES = 0.95, 400, 1000, 80
LEAST_BIN, MOST_BIN, BINS, CHUNK = 1024, 16_384, 32, 4096
#: Stands for a missing id where ids are sorted.
LAST = np.iinfo(np.int64).max


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :], 0)


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([squared(x[at : at + 4096], centres).argmin(1) for at in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            centres[n == 0] = x[r.choice(len(x), int((n == 0).sum()))]
    return centres


@dataclass
class Quantiser:
    """Coarse centroids (cells x dimension) and one codebook for each part of the residuals."""

    cells: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, seed: int = 7) -> Quantiser:
        """``rows`` is the size of the whole table: the cells grow with its square root up to MOST_CELLS."""
        cells = k_means(sample, max(1, min(MOST_CELLS, int(rows**0.5))), 12, seed)
        rest = sample - cells[squared(sample, cells).argmin(1)]
        parts = min(PARTS, sample.shape[1])
        cuts = [round(k * sample.shape[1] / parts) for k in range(parts + 1)]
        return cls(cells, [k_means(rest[:, a:b], CODES, 8, seed + k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))], cuts)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Cell, codes, the part of the squared distance that no query changes (|r|^2 + 2 c.r for the coded residual r), and the norm of the coding error."""
        cell = squared(x, self.cells).argmin(1)
        rest = x - self.cells[cell]
        codes = np.stack([squared(rest[:, a:b], book).argmin(1) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])], 1)
        r = np.concatenate([book[c] for book, c in zip(self.books, codes.T)], 1)
        return cell, codes.astype(np.uint8), (r * r).sum(1) + 2 * (self.cells[cell] * r).sum(1), np.sqrt(((rest - r) ** 2).sum(1))

    def table(self, query: np.ndarray) -> np.ndarray:
        """Inner products of the query with every code, part by part: the same table serves all cells."""
        out = np.zeros((len(self.books), CODES))
        for k, (book, a, b) in enumerate(zip(self.books, self.cuts, self.cuts[1:])):
            out[k, : len(book)] = book @ query[a:b]
        return out

    def share_to_probe(self, sample: np.ndarray, k: int = 10) -> float:
        """The share of the vectors that the probed cells must hold to have RECALL of the neighbours in the sample."""
        cell = squared(sample, self.cells).argmin(1)
        sizes = np.bincount(cell, minlength=len(self.cells))
        asked = sample[:: max(1, len(sample) // CALIBRATED)][:CALIBRATED]
        apart = squared(asked, sample)
        near = np.argsort(apart, 1)[:, 1 : k + 1]
        order = squared(asked, self.cells).argsort(1)
        place = order.argsort(1)
        met = np.take_along_axis(sizes[order].cumsum(1), np.take_along_axis(place, cell[near], 1), 1) / len(sample)
        return float(np.quantile(met, RECALL)) if met.size else 1.0


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def packed_vectors(x: np.ndarray) -> list[bytes]:
    """Each row's bytes, as floats where that loses nothing and as doubles elsewhere."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return [(f if one else d).tobytes() for f, d, one in zip(small, x, (small == x).all(1))]


def unpacked_vectors(rows: list[bytes], dimension: int) -> np.ndarray:
    return np.array([np.frombuffer(b, np.float32 if len(b) == 4 * dimension else np.float64) for b in rows], np.float64).reshape(-1, dimension)


def exact_distances(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of the rows of ``x`` to ``v``, summed in the order of the components: equal vectors get equal distances in every task."""
    total = np.zeros(len(x))
    for a, b in zip(x.T, v):
        total += (a - b) * (a - b)
    return np.sqrt(total)


def nearest_of(x: np.ndarray, v: np.ndarray, about: np.ndarray, error: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact distances of the ``k`` rows of ``x`` nearest to ``v``, ties in the order of the rows.

    ``about`` are the coded squared distances, within ``slack`` of the coded rows'
    own, and ``error`` the distances of the rows from their coded forms.
    """
    some = np.arange(len(x))
    if len(x) > 4 * CANDIDATES:
        start = np.argpartition(about, max(CANDIDATES, k))[: max(CANDIDATES, k)]
        reach = np.partition(exact_distances(x[start], v), k - 1)[k - 1]
        least = np.sqrt(np.maximum(about - slack, 0)) - error
        some = np.flatnonzero(least <= reach + np.sqrt(slack) * 1e-3)
    d = exact_distances(x[some], v)
    first = np.argsort(d, kind="stable")[:k]
    return some[first], d[first]


def usable(table: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row, vec_id, v) of the rows that take part, stored; v is an array of doubles."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(id).cast("long").alias("vec_id"), F.when(good, F.col(vector).cast("array<float>")).alias("f"), F.when(good, v).alias("v")).filter("v is not null")
    # stored as floats where that loses nothing
    exact = F.forall("v", lambda x: x == x.cast("float").cast("double"))
    rows = rows.select("vec_id", F.when(exact, F.col("f")).alias("f"), F.when(~exact, F.col("v")).alias("d"), F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "vectors").select("row", "vec_id", F.coalesce(F.col("f").cast("array<double>"), F.col("d")).alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (usual["n"] if usual else 0))


def packed(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bin of each cell and its number of bins of ``most`` rows: large cells get bins of their own, small ones share them."""
    first, bins = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    now, filled = 0, 0
    for c, n in enumerate(sizes.tolist()):
        if filled and filled + n > most:
            now, filled = now + 1, 0
        first[c] = now
        if bins[c] > 1:
            now, filled = now + int(bins[c]), 0
        else:
            filled += n
    return first, bins


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_row, query_id, rank, vec_id, score): each query's nearest found. Both inputs come from ``usable``."""
    total = vectors.count()
    if not total:
        return vectors.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    part = F.xxhash64("row", F.lit(9)).cast("double") / F.lit(2.0**64) + 0.5
    sample = vectors.filter(part < SAMPLE / total).select("v").limit(SAMPLE).collect()
    sample = sample or vectors.select("v").limit(SAMPLE).collect()
    q = Quantiser.fit(np.array([r["v"] for r in sample]), total)
    dimension = q.cells.shape[1]

    share = q.share_to_probe(np.array([r["v"] for r in sample]), k)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), dimension)
            cell, codes, own, error = q.encode(x)
            columns = [batch.column("row"), batch.column("vec_id"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(own), pa.array(error), pa.array(packed_vectors(x), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "vec_id", "cell", "codes", "own", "error", "exact"])

    index = stored(vectors.mapInArrow(coded, "row long, vec_id long, cell int, codes binary, own double, error double, exact binary"), "cells")
    sizes = np.zeros(len(q.cells), np.int64)
    for r in index.groupBy("cell").count().collect():  # one row a cell, MOST_CELLS at most
        sizes[r["cell"]] = r["count"]
    first_bin, bins = packed(sizes, max(LEAST_BIN, min(MOST_BIN, total // BINS)))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = squared(matrix(batch.column("v"), dimension), q.cells).argsort(1)
            met = sizes[order].cumsum(1)
            n = ((met < max(ENOUGH, share * total)).sum(1) + 1).clip(max=order.shape[1])
            at, bin_of, cells = [], [], []
            for x, (o, m) in enumerate(zip(order, n)):
                by_bin: dict[int, list[int]] = {}
                for c in o[:m].tolist():
                    for b in range(first_bin[c], first_bin[c] + bins[c]):
                        by_bin.setdefault(b, []).append(c)
                at += [x] * len(by_bin)
                bin_of += by_bin
                cells += by_bin.values()
            x = matrix(batch.column("v"), dimension)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("row").take(take), pa.array(packed_vectors(x), pa.binary()).take(take), pa.array(bin_of, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["query", "v", "bin", "cells"])

    probes = stored(queries.select("row", "v").mapInArrow(probed, "query long, v binary, bin int, cells array<int>"), "probes")
    # a row for each bin that is probed: their number is bounded by the cells and by total / MOST_BIN, and it is counted
    chunks = stored(probes.groupBy("bin").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    of_bin = lambda: small_side(chunks.select(F.col("bin").alias("_bin"), F.col("chunks").alias("_chunks")))
    chunk = F.pmod(F.xxhash64("query", F.lit(1)), "_chunks").cast("int").alias("chunk")
    left = probes.join(of_bin(), F.col("bin") == F.col("_bin")).select("query", "v", "bin", "cells", chunk)
    of_cell = lambda xs: F.element_at(F.array(*[F.lit(int(x)) for x in xs]), F.col("cell") + 1)
    bin_of = of_cell(first_bin) + F.pmod(F.xxhash64("row", F.lit(2)), of_cell(bins)).cast("int")
    right = index.withColumn("bin", bin_of.cast("int")).join(of_bin(), F.col("bin") == F.col("_bin"))
    right = right.select(*index.columns, "bin", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))

    def best(asking: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if asking.num_rows and block.num_rows:
            ids, rows = pc.fill_null(block.column("vec_id"), LAST).to_numpy(), block.column("row").to_numpy()
            order = np.lexsort((rows, ids))
            ids, rows = ids[order], rows[order]
            cell, own = block.column("cell").to_numpy()[order], block.column("own").to_numpy()[order]
            codes = np.frombuffer(b"".join(block.column("codes").to_pylist()), np.uint8).reshape(len(rows), -1)[order].astype(np.intp)
            error = block.column("error").to_numpy()[order]
            x = unpacked_vectors(block.column("exact").to_pylist(), dimension)[order]
            size = max((x * x).sum(1).max(), (q.cells * q.cells).sum(1).max())
            steps = np.arange(codes.shape[1])
            for query, v, cells in zip(asking.column("query").to_pylist(), unpacked_vectors(asking.column("v").to_pylist(), dimension), asking.column("cells").to_pylist()):
                to_cell = np.full(len(q.cells), np.inf)
                to_cell[cells] = ((q.cells[cells] - v) ** 2).sum(1)
                some = np.flatnonzero(np.isfinite(to_cell[cell]) & (rows != query))
                d = to_cell[cell[some]] + own[some] - 2 * q.table(v)[steps, codes[some]].sum(1)
                # rounding of the coded distance is far below this share of the vectors' squared lengths
                near, exact = nearest_of(x[some], v, d, error[some], k, 1e-11 * max(size, float(v @ v)))
                out.append((np.full(len(near), query), rows[some[near]], ids[some[near]], exact))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["query", "row", "vec_id", "score"]
        return pa.table([pa.array(c, kind, mask=c == LAST if name == "vec_id" else None) if len(c) else pa.array([], kind) for c, kind, name in zip(columns, kinds, names)], names=names)

    keys = ["bin", "chunk"]
    units = max(1, min(chunks.agg(F.sum("chunks")).first()[0] or 1, 100_000))
    deal = lambda df: df.repartition(units, *keys)
    found = deal(left).groupBy(*keys).cogroup(deal(right).groupBy(*keys)).applyInArrow(best, "query long, row long, vec_id long, score double")
    scored = found.join(queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id")), "query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "row"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("query").alias("query_row"), "query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(ship_package(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(vectors, vectors.filter("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")
