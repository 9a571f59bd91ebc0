"""Pairwise alignment: chaining of exact matches over a sparse graph, and gap-affine alignment by wavefronts.

Both are dynamic programmes over one pair at a time; Spark deals the pairs.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

MATCH, GAP, GAP_OPEN = 1, -1, -1


def neighbours(xs: list[int], ys: list[int], lens: list[int], reach: int) -> list[list[int]]:
    """For each match, the next match on every diagonal near its end.

    Seen from its last cell, a diagonal ``t`` off is searched from the border of the
    box on, over ``reach + 1 - t`` antidiagonals: a triangle, not the whole box. Of
    matches that start in one cell the first counts.
    """
    by_diagonal: dict[int, dict[int, int]] = defaultdict(dict)
    for j, (x, y) in enumerate(zip(xs, ys)):
        by_diagonal[x - y].setdefault(x + y, j)
    sorted_by = {d: np.array(sorted(at)) for d, at in by_diagonal.items()}
    out: list[list[int]] = []
    for i, (x, y, n) in enumerate(zip(xs, ys, lens)):
        x, y = x + max(0, n - 1), y + max(0, n - 1)
        near = []
        for t in [*range(reach + 1), *range(-1, -reach - 1, -1)]:
            places = sorted_by.get(x - y + t)
            if places is None:
                continue
            low = x + y + abs(t)
            k = int(np.searchsorted(places, low))
            if k < len(places) and places[k] <= low + reach + 1 - abs(t) and by_diagonal[x - y + t][int(places[k])] != i:
                near.append(by_diagonal[x - y + t][int(places[k])])
        out.append(near)
    return out


def best_chain(xs: list[int], ys: list[int], lens: list[int], x_size: int, y_size: int, reach: int) -> tuple[int, list[int]]:
    """Score and matches of the best chain.

    A match gives its length; a change of diagonal costs one a step and one to
    open. Ends within ``reach`` of the borders are free. Of equal predecessors the
    earlier match wins, and an earlier match before the start.
    """
    n, start = len(xs), GAP_OPEN + (x_size + y_size) * GAP
    before: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(neighbours(xs, ys, lens, reach)):
        for j in near:
            before[j].append(i)
    score, back = [start] * n, [-1] * n
    for i in sorted(range(n), key=lambda k: (xs[k] + ys[k], xs[k], -lens[k], k)):
        options = [(p, score[p]) for p in sorted(before[i])]
        if xs[i] <= reach or ys[i] <= reach:
            options.insert(sum(p < i for p, _ in options), (-1, 0))
        for p, s in options:
            gap = abs((xs[i] - ys[i]) - (xs[p] - ys[p])) if p >= 0 else 0
            s += lens[i] * MATCH + (gap * GAP + GAP_OPEN if gap else 0)
            if s > score[i]:
                score[i], back[i] = s, p
    ends = [i for i in range(n) if xs[i] + lens[i] - 1 >= x_size - reach or ys[i] + lens[i] - 1 >= y_size - reach]
    if not ends:
        return start, []
    last = max(ends, key=lambda i: (score[i], -i))
    path, i = [], last
    while i >= 0:
        path.append(i)
        i = back[i]
    return score[last], path[::-1]


def chain_matches(matches: DataFrame, sizes: DataFrame, reach: int) -> DataFrame:
    """a, b, score, step, x, y, len of each pair's best chain. ``sizes`` has read and size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y", "len"]).reset_index(drop=True)
        score, path = best_chain(*[pdf[c].tolist() for c in ("x", "y", "len")], int(pdf["x_size"][0]), int(pdf["y_size"][0]), reach)
        out = pdf.loc[path, ["a", "b", "x", "y", "len"]].reset_index(drop=True)
        return out.assign(score=score, step=range(len(path)))[["a", "b", "score", "step", "x", "y", "len"]]

    sized = matches.join(sizes.select(F.col("read").alias("a"), F.col("size").alias("x_size")), "a").join(sizes.select(F.col("read").alias("b"), F.col("size").alias("y_size")), "b")
    return sized.groupBy("a", "b").applyInPandas(run, "a long, b long, score long, step long, x long, y long, len long")


def wavefront(one: str, two: str, mismatch: int = 1, gap_open: int = 1, gap_extend: int = 1, most: int | None = None, prune: int | None = None) -> tuple[int, str] | None:
    """The least cost of aligning two strings and a CIGAR for it: = and X, I consumes the first string, D the second.

    A gap of n costs gap_open + n * gap_extend. Fronts are kept by cost: for each
    diagonal (place in one minus place in two) the furthest place in ``one``. None if
    the cost would pass ``most``; ``prune`` drops diagonals that lag that far behind.
    """
    n, m = len(one), len(two)
    fronts: list[dict[str, dict[int, int]]] = []

    def extend(at: dict[int, int]) -> None:
        for d, i in at.items():
            j = i - d
            while i < n and j < m and one[i] == two[j]:
                i, j = i + 1, j + 1
            at[d] = i

    def get(cost: int, kind: str) -> dict[int, int]:
        return fronts[cost][kind] if 0 <= cost < len(fronts) else {}

    first = {0: 0}
    extend(first)
    fronts.append({"M": first, "I": {}, "D": {}})
    while fronts[-1]["M"].get(n - m, -1) < n:
        cost = len(fronts)
        if most is not None and cost > most:
            return None
        opened, longer = get(cost - gap_open - gap_extend, "M"), get(cost - gap_extend, "I")
        ins = {d + 1: i + 1 for d, i in opened.items() if i < n}
        for d, i in longer.items():
            if i < n:
                ins[d + 1] = max(ins.get(d + 1, -1), i + 1)
        longer = get(cost - gap_extend, "D")
        dele = {d - 1: i for d, i in opened.items() if i - d < m}
        for d, i in longer.items():
            if i - d < m:
                dele[d - 1] = max(dele.get(d - 1, -1), i)
        now = {d: i + 1 for d, i in get(cost - mismatch, "M").items() if i < n and i - d < m}
        for more in (ins, dele):
            for d, i in more.items():
                now[d] = max(now.get(d, -1), i)
        extend(now)
        if prune is not None and now:
            ahead = max(2 * i - d for d, i in now.items())
            now = {d: i for d, i in now.items() if 2 * i - d >= ahead - prune}
        fronts.append({"M": now, "I": ins, "D": dele})
    # back from the end
    ops: list[tuple[str, int]] = []
    cost, kind, d, i = len(fronts) - 1, "M", n - m, n
    total = cost
    while True:
        if kind == "M":
            came = [(get(cost - mismatch, "M").get(d, -2) + 1, "X"), (fronts[cost]["I"].get(d, -1), "I"), (fronts[cost]["D"].get(d, -1), "D")]
            from_, op = max((c for c in came if c[0] <= i), key=lambda c: c[0]) if cost else (0, "")
            if i > from_:
                ops.append(("=", i - from_))
            i = from_
            if not cost:
                break
            if op == "X":
                ops.append(("X", 1))
                cost, i = cost - mismatch, i - 1
            else:
                kind = op
        else:
            step, back = (1, i - 1) if kind == "I" else (-1, i)
            ops.append((kind, 1))
            d -= step
            if get(cost - gap_extend, kind).get(d, -1) == back:
                cost -= gap_extend
            else:
                cost, kind = cost - gap_open - gap_extend, "M"
            i = back
    merged: list[list] = []
    for op, k in reversed(ops):
        if merged and merged[-1][0] == op:
            merged[-1][1] += k
        else:
            merged.append([op, k])
    return total, "".join(f"{k}{op}" for op, k in merged)


def cigar_cost(cigar: list[tuple[str, int]], mismatch: int = 1, gap_open: int = 1, gap_extend: int = 1) -> int:
    return sum(0 if op == "=" else k * mismatch if op == "X" else gap_open + k * gap_extend for op, k in cigar)


def align(one: Column, two: Column, most: int | None = None, prune: int | None = None) -> Column:
    """struct<cost, cigar> of two string columns; null where a string is null or the cost passes ``most``."""

    @F.pandas_udf("cost int, cigar string")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [wavefront(x, y, most=most, prune=prune) if x is not None and y is not None else None for x, y in zip(a, b)]
        return pd.DataFrame({"cost": pd.array([g[0] if g else None for g in got], "Int32"), "cigar": [g[1] if g else None for g in got]})

    return run(one, two)
