"""Edit distance of a pattern to a whole text, its beginnings or any part of it, as column expressions.

The recurrence is Myers' on bit vectors: one column of the dynamic program is a vector of
upward and one of downward steps, and a letter of the text turns it into the next by a
few operations on longs. A pattern is cut into blocks of 62 letters, so that sums stay
within a signed long; the step across a block's border is handed on to the next block.
The distance at the pattern's last letter is all that is counted.

Nulls give null. Letters are code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

BITS = 62
_MASK = (1 << BITS) - 1
#: ``infix``: the pattern against any part of the text; ``prefix``: against its beginnings; ``whole``: against all of it.
MODES = ("infix", "prefix", "whole")


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _not(x: Column) -> Column:
    return x.bitwiseXOR(F.lit(_MASK))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def _up(x: Column, low: Column) -> Column:
    """Shifted by one letter, with ``low`` (0 or 1) behind it."""
    return F.shiftleft(x, 1).bitwiseAND(F.lit(_MASK)).bitwiseOR(low)


def _advanced(pv: Column, mv: Column, eq: Column, hin: Column, high: Column) -> Column:
    """struct(pv, mv, h): a block after one letter of the text; ``hin`` is the step that comes in, ``h`` that at the bit ``high``."""
    down, up = (hin < 0).cast("long"), (hin > 0).cast("long")
    met = eq.bitwiseOR(down)
    xv = eq.bitwiseOR(mv)
    xh = (met.bitwiseAND(pv) + pv).bitwiseXOR(pv).bitwiseOR(met).bitwiseAND(F.lit(_MASK))

    def vertical(h: Column) -> Column:
        ph, mh = _up(h["ph"], up), _up(h["mh"], down)
        out = F.when(h["ph"].bitwiseAND(high) != 0, 1).when(h["mh"].bitwiseAND(high) != 0, -1).otherwise(0).cast("long")
        return F.struct(mh.bitwiseOR(_not(xv.bitwiseOR(ph))).alias("pv"), ph.bitwiseAND(xv).alias("mv"), out.alias("h"))

    return _let(xh, lambda x: _let(F.struct(mv.bitwiseOR(_not(x.bitwiseOR(pv))).alias("ph"), pv.bitwiseAND(x).alias("mh")), vertical))


def _masks(letters: Column, blocks: Column) -> Column:
    """For each letter of the pattern, the places where it stands in each block as bits."""
    places = lambda c, b: F.aggregate(F.transform(F.slice(letters, b * BITS + 1, F.lit(BITS)), lambda x, k: F.when(x == c, _bit(k)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))
    return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: places(c, b)))))


def edit_distance(pattern: Column, text: Column, mode: str = "infix") -> Column:
    """struct(distance long, stop long): the least distance of ``pattern``, and where the first part of ``text`` that has it ends (letters before it)."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    split = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    m, n = F.length(pattern).cast("long"), F.length(text).cast("long")
    blocks = F.ceil(m / BITS).cast("int")
    first = F.lit(0 if mode == "infix" else 1).cast("long")

    zero = F.lit(0).cast("long")

    def best(acc: Column, h: Column) -> list[Column]:
        """The counted fields after one more letter, at which the distance at the pattern's end changed by ``h``."""
        score = acc["score"] + h
        better = score < acc["best"]
        return [score.alias("score"), F.least(score, acc["best"]).alias("best"), F.when(better, acc["at"] + 1).otherwise(acc["stop"]).alias("stop"), (acc["at"] + 1).alias("at")]

    begin = [m.alias("score"), m.alias("best"), zero.alias("stop"), zero.alias("at")]

    def short(p: Column) -> Column:
        """Patterns of one block."""

        def step(acc: Column, c: Column) -> Column:
            eq = F.coalesce(F.try_element_at(p["masks"], c)[0], zero)
            return _let(_advanced(acc["pv"], acc["mv"], eq, first, p["high"]), lambda now: F.struct(now["pv"].alias("pv"), now["mv"].alias("mv"), *best(acc, now["h"])))

        return F.aggregate(split(text), F.struct(F.lit(_MASK).alias("pv"), zero.alias("mv"), *begin), step)

    def long(p: Column) -> Column:
        """Patterns of several blocks, which are gone through for each letter."""

        def step(acc: Column, c: Column) -> Column:
            eqs = F.try_element_at(p["masks"], c)
            high = lambda b: F.when(b == p["blocks"] - 1, p["high"]).otherwise(F.lit(1 << (BITS - 1)))

            def block(done: Column, b: Column) -> Column:
                now = _advanced(acc["v"][b]["pv"], acc["v"][b]["mv"], F.coalesce(eqs[b], zero), done["h"], high(b))
                return _let(now, lambda x: F.struct(F.concat(done["v"], F.array(F.struct(x["pv"].alias("pv"), x["mv"].alias("mv")))).alias("v"), x["h"].alias("h")))

            column = F.aggregate(F.sequence(F.lit(0), p["blocks"] - 1), F.struct(F.array().cast("array<struct<pv:bigint,mv:bigint>>").alias("v"), first.alias("h")), block)
            return _let(column, lambda now: F.struct(now["v"].alias("v"), *best(acc, now["h"])))

        vectors = F.transform(F.sequence(F.lit(1), p["blocks"]), lambda _: F.struct(F.lit(_MASK).alias("pv"), zero.alias("mv")))
        return F.aggregate(split(text), F.struct(vectors.alias("v"), *begin), step)

    def run(p: Column) -> Column:
        if mode == "whole":
            found = lambda x: F.struct(x["score"].alias("distance"), x["at"].alias("stop"))
        else:
            found = lambda x: F.struct(x["best"].alias("distance"), x["stop"].alias("stop"))
        return F.when(p["blocks"] == 1, _let(short(p), found)).otherwise(_let(long(p), found))

    prepared = F.struct(blocks.alias("blocks"), _bit(F.pmod(m - 1, F.lit(BITS))).alias("high"), _masks(split(pattern), blocks).alias("masks"))
    empty = F.struct((n if mode == "whole" else F.lit(0).cast("long")).alias("distance"), (n if mode == "whole" else F.lit(0).cast("long")).alias("stop"))
    return F.when(pattern.isNull() | text.isNull(), F.lit(None)).when(m == 0, empty).otherwise(_let(prepared, run))


#: Letters of a stretch of a text, and stretches that are gone through together.
STRETCH, TOGETHER = 1024, 4096


def _advance(codes: np.ndarray, sizes: np.ndarray, masks: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Least distance of a pattern of ``m`` letters to any part of each stretch (rows of ``codes``, longest first), and the letters before its first end."""
    n = len(codes)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score, best, stop = np.full(n, m, np.int64), np.full(n, m, np.int64), np.zeros(n, np.int64)
    one, last = np.uint64(1), np.uint64(m - 1)
    columns, active = np.ascontiguousarray(codes.T), np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for j, k in enumerate(active):
        p, q, s = pv[:k], mv[:k], score[:k]
        eq = masks[columns[j, :k]]
        xv = eq | q
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = q | ~(xh | p), p & xh
        s += ((ph >> last) & one).astype(np.int64)
        s -= ((mh >> last) & one).astype(np.int64)
        ph <<= one
        mh <<= one
        pv[:k], mv[:k] = mh | ~(xv | ph), ph & xv
        better = np.flatnonzero(s < best[:k])
        best[better], stop[better] = s[better], j + 1
    return best, stop


def nearest_parts(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, distance and stop as ``edit_distance`` finds them in mode ``infix`` for one pattern of at most 64 letters; null for a null text.

    A part of a text at a distance up to the pattern's length has at most twice its letters, so
    a text is cut in stretches that begin so many letters early; the vectors of thousands of
    stretches take one letter each at a time.
    """
    if not 0 < len(pattern) <= 64:
        raise ValueError("the pattern must have 1 to 64 letters")
    m, points = len(pattern), [ord(c) for c in pattern]
    kinds = np.array(sorted(set(points)), np.uint32)
    masks = np.array([sum(1 << i for i, c in enumerate(points) if c == kind) for kind in kinds.tolist()] + [0], np.uint64)

    def coded(t: str) -> np.ndarray:
        letters = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(kinds, letters), len(kinds) - 1)
        return np.where(kinds[at] == letters, at, len(kinds)).astype(np.uint8)

    def found(stretches: list[tuple[int, int, np.ndarray]], least: dict[int, tuple[int, int]]) -> None:
        stretches = sorted(stretches, key=lambda s: -len(s[2]))
        sizes = np.array([len(s[2]) for s in stretches])
        codes = np.zeros((len(sizes), sizes[0]), np.uint8)
        for row, s in zip(codes, stretches):
            row[: len(s[2])] = s[2]
        for (r, start, _), b, e in zip(stretches, *(c.tolist() for c in _advance(codes, sizes, masks, m))):
            if b < m:
                least[r] = min(least[r], (b, start + e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least, waiting = {}, []
            for r, t in enumerate(batch.column(1)):
                if t.is_valid:
                    least[r], codes = (m, 0), coded(t.as_py())
                    for at in range(0, len(codes), STRETCH):
                        start = max(0, at - 2 * m)
                        waiting.append((r, start, codes[start : at + STRETCH]))
                        if len(waiting) == TOGETHER:
                            found(waiting, least)
                            waiting = []
            if waiting:
                found(waiting, least)
            got = [least.get(r, (None, None)) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[c] for g in got], pa.int64()) for c in (0, 1)]], names=[key, "distance", "stop"])

    out = StructType([rows.schema[key], StructField("distance", LongType()), StructField("stop", LongType())])
    return rows.select(key, text).mapInArrow(run, out)
