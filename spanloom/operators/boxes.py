"""Joins of boxes in a plane: tiles on both axes, full ones cut in four again, each pair owned by one tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.operators.blocks import BOUND, hot_keys, self_pairs

#: How often a full tile may be cut in four.
LEVELS = 5


def _touched(low: str, high: str, width: Column, first: Column, last: Column) -> Column:
    """Numbers of the tiles of ``width`` that [low, high) touches, from ``first`` to ``last``."""
    return F.sequence(F.greatest(first, F.floor(F.col(low) / width)), F.least(last, F.floor((F.col(high) - 1) / width)))


def tiled(rows: DataFrame, keys: list[str], width: int, bound: int = BOUND, levels: int = LEVELS) -> DataFrame:
    """``rows`` (boxes [x0, x1) by [y0, y1) in the plane of their ``keys``) once for each tile they touch, with _level, _w, _tx and _ty.

    Tiles are ``width`` wide at first. One with more than ``bound`` boxes, which cover
    less than half of it on average, is cut in four, down to ``levels`` times or a width of
    one. Tiles cover the plane without overlap, whatever their level.
    """
    out, level, w = None, 0, width
    everywhere = lambda low, high: (F.floor(F.col(low) / w), F.floor((F.col(high) - 1) / w))
    now = rows.filter((F.col("x0") < F.col("x1")) & (F.col("y0") < F.col("y1")))
    now = now.withColumn("_tx", F.explode(_touched("x0", "x1", F.lit(w), *everywhere("x0", "x1")))).withColumn("_ty", F.explode(_touched("y0", "y1", F.lit(w), *everywhere("y0", "y1"))))
    tile = [*keys, "_tx", "_ty"]
    while True:
        marked = now.withColumns({"_level": F.lit(level), "_w": F.lit(w)})
        side = lambda t, low, high: F.least(F.col(high), (F.col(t) + 1) * w) - F.greatest(F.col(low), F.col(t) * w)  # noqa: B023, E731
        covered = now.withColumn("_area", side("_tx", "x0", "x1") * side("_ty", "y0", "y1"))
        full = hot_keys(covered, tile, bound, having=F.avg("_area") * 2 < w * w) if level < levels and w > 1 else None
        if full is None:
            return marked if out is None else out.unionByName(marked)
        kept = marked.join(full, tile, "left_anti").select(*marked.columns)
        out = kept if out is None else out.unionByName(kept)
        half = w // 2 if w % 2 == 0 else 1
        split = now.join(full.drop("_n"), tile)
        for t, low, high in (("_tx", "x0", "x1"), ("_ty", "y0", "y1")):
            split = split.withColumn(t, F.explode(_touched(low, high, F.lit(half), F.col(t) * (w // half), (F.col(t) + 1) * (w // half) - 1)))
        now, w, level = split.select(*now.columns), half, level + 1


def intersecting(rows: DataFrame, keys: list[str], order: list[str], width: int, bound: int = BOUND, levels: int = LEVELS) -> DataFrame:
    """Pairs of boxes, aliases a and b, that intersect in the plane of equal ``keys``, a before b in ``order``.

    A pair counts in the tile that holds the corner where its intersection begins.
    """
    corner = lambda c, a, b: F.floor(F.greatest(f"{a}.{c}", f"{b}.{c}") / F.col(f"{a}._w"))

    def on(a: str, b: str) -> Column:
        meet = (F.col(f"{a}.x0") < F.col(f"{b}.x1")) & (F.col(f"{b}.x0") < F.col(f"{a}.x1")) & (F.col(f"{a}.y0") < F.col(f"{b}.y1")) & (F.col(f"{b}.y0") < F.col(f"{a}.y1"))
        before = F.struct(*[F.col(f"{a}.{c}") for c in order]) < F.struct(*[F.col(f"{b}.{c}") for c in order])
        return meet & before & (corner("x0", a, b) == F.col(f"{a}._tx")) & (corner("y0", a, b) == F.col(f"{a}._ty"))

    return self_pairs(tiled(rows, keys, width, bound, levels), [*keys, "_level", "_tx", "_ty"], on, bound)


def nearest_on_diagonals(points: DataFrame, corners: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """For each corner (keys, x, y) and diagonal the first of the ``points`` (keys, x, y) in the box of ``reach`` behind it: near_x, near_y, diagonal, distance.

    The box is closed. Equal points and equal corners count as one, so a tile as wide as the
    box holds no more than (reach + 1) ** 2 of either, however many rows there are; a corner
    looks into the four tiles that its box can touch. The distance is along the antidiagonals.
    """
    w = reach + 1
    tile = lambda c: F.floor(F.col(c) / w)
    two = lambda c: F.explode(F.array(tile(c), tile(c) + 1))
    p = points.select(*keys, F.col("x").alias("near_x"), F.col("y").alias("near_y")).distinct().withColumns({"_tx": tile("near_x"), "_ty": tile("near_y")})
    c = corners.select(*keys, "x", "y").distinct().withColumn("_tx", two("x")).withColumn("_ty", two("y"))
    inside = F.col("near_x").between(F.col("x"), F.col("x") + reach) & F.col("near_y").between(F.col("y"), F.col("y") + reach)
    met = c.join(p, [*keys, "_tx", "_ty"]).filter(inside)
    diagonal = (F.col("near_x") - F.col("near_y")).alias("diagonal")
    best = met.groupBy(*keys, "x", "y", diagonal).agg(F.min(F.struct((F.col("near_x") + F.col("near_y") - F.col("x") - F.col("y")).alias("distance"), "near_x", "near_y")).alias("m"))
    return best.select(*keys, "x", "y", "diagonal", "m.near_x", "m.near_y", "m.distance")
