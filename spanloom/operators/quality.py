"""Statistics of base qualities along a read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanloom.functions.scalars import error_probability

#: Thresholds of the half-split rule.
RISE, LEAST_MEAN, LEAST_VARIANCE, LEAST_LENGTH = 0.09, 0.15, 0.025, 6


def halves(rows: DataFrame) -> DataFrame:
    """Mean and population variance of the error probability in both halves of a read, and whether its second half is degraded."""
    w = Window.partitionBy("read")
    placed = rows.select("read", error_probability(F.col("q").cast("double")).alias("p"), (F.row_number().over(w.orderBy("pos")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    left = F.col("i") < F.floor(F.col("n") / 2)
    pick = lambda f, side, name: f(F.when(side, F.col("p"))).alias(name)
    out = placed.groupBy("read").agg(F.max("n").alias("n"), pick(F.avg, left, "left_mean"), pick(F.var_pop, left, "left_var"), pick(F.avg, ~left, "right_mean"), pick(F.var_pop, ~left, "right_var"))
    degraded = (F.col("n") >= LEAST_LENGTH) & (F.col("right_mean") - F.col("left_mean") > RISE) & (F.col("right_mean") >= LEAST_MEAN) & (F.col("right_var") > F.col("left_var")) & (F.col("right_var") > LEAST_VARIANCE)
    return out.withColumn("is_degraded", F.coalesce(degraded, F.lit(False)))


def kernel(width: int, sigma: float) -> list[float]:
    """A Gaussian at offsets -width to width, normalised to sum 1."""
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-width, width + 1)]
    return [x / sum(raw) for x in raw]


def smoothed(rows: DataFrame, width: int, sigma: float) -> DataFrame:
    """Error probability convolved with the kernel, where the whole kernel fits in the read: read, pos, p, smooth."""
    w = Window.partitionBy("read").orderBy("pos")
    p = rows.select("read", "pos", error_probability(F.col("q").cast("double")).alias("p"))
    terms = [F.lag("p", -k).over(w) * weight for k, weight in zip(range(-width, width + 1), kernel(width, sigma))]
    return p.withColumn("smooth", sum(terms[1:], terms[0])).filter("smooth is not null")


def _ln(x: Column) -> Column:
    """The logarithm with its limit at 0 and NaN below, as DuckDB has it; Spark's is null there."""
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan")))


def breakpoint(rows: DataFrame, step: int, at_least: int = 2) -> DataFrame:
    """For each read the cut, a multiple of ``step``, at which two Bernoulli rates explain the probabilities best, and the gain in log-likelihood.

    Prefix sums give both sides of every cut; the best is an aggregate. The gain is NaN, and
    above all others, at a cut with a side whose probabilities are all 1 (0 times the logarithm of 0);
    that is told by counts, as the difference of two sums misses such a side by its rounding.
    Of equal gains the first cut counts; without any gain it is null.
    """
    w = Window.partitionBy("read").orderBy("pos")
    run, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = rows.select("read", "pos", error_probability(F.col("q").cast("double")).alias("p"))
    unsure = F.sum(F.when(F.col("p") == 1, 0).otherwise(1))
    p = p.select("read", F.row_number().over(w).alias("i"), F.sum("p").over(run).alias("left"), F.sum("p").over(whole).alias("all"), F.count("*").over(whole).alias("n"), unsure.over(run).alias("left_unsure"), unsure.over(whole).alias("all_unsure"))
    like = lambda s, n: s * _ln(s / n) + (n - s) * _ln(1 - s / n)
    rest, behind = F.col("all") - F.col("left"), F.col("n") - F.col("i")
    right = F.when(F.col("left_unsure") == F.col("all_unsure"), behind.cast("double")).otherwise(rest)
    gain = like(F.col("left"), F.col("i")) + like(right, behind) - like(F.col("all"), F.col("n"))
    cuts = p.filter((F.col("i") % step == 0) & (F.col("n") - F.col("i") >= at_least)).withColumn("gain", gain)
    best = F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("i")))
    return cuts.groupBy("read").agg(F.max_by("i", best).cast("long").alias("cut"), F.max("gain").alias("gain"))


def smoothed_to_the_ends(rows: DataFrame, width: int, sigma: float) -> DataFrame:
    """As ``smoothed``, at every position: where the kernel reaches beyond the read, what lies in the read is summed."""
    w = Window.partitionBy("read").orderBy("pos")
    p = rows.select("read", "pos", error_probability(F.col("q").cast("double")).alias("p"))
    terms = [F.coalesce(F.lag("p", -k).over(w), F.lit(0.0)) * weight for k, weight in zip(range(-width, width + 1), kernel(width, sigma))]
    return p.withColumn("smooth", sum(terms[1:], terms[0]))


def _placed(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("read")
    p = error_probability(F.col("q").cast("double"))
    return rows.select("read", "pos", p.alias("p"), F.row_number().over(w.orderBy("pos")).alias("i"), F.count("*").over(w).alias("n"))


def penalised_breakpoint(rows: DataFrame, step: int, beta: float) -> DataFrame:
    """For each read the cut, a multiple of ``step``, whose two means explain the probabilities best, if it gains more than ``beta``.

    The cost of n values with squared deviations S from their mean is n (log 2 pi + log(S / n + 1)).
    """
    run = Window.partitionBy("read").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("read")
    sums = _placed(rows).select("read", "i", "n", *[f.over(w).alias(k) for k, f, w in (("l1", F.sum("p"), run), ("l2", F.sum(F.col("p") * F.col("p")), run), ("a1", F.sum("p"), whole), ("a2", F.sum(F.col("p") * F.col("p")), whole))])
    cost = lambda n, s1, s2: n * (math.log(2 * math.pi) + F.log(F.greatest(s2 - s1 * s1 / n, F.lit(0.0)) / n + 1))
    c = F.col
    gain = cost(c("n"), c("a1"), c("a2")) - cost(c("i"), c("l1"), c("l2")) - cost(c("n") - c("i"), c("a1") - c("l1"), c("a2") - c("l2")) - beta
    cuts = sums.filter((F.col("i") % step == 0) & (F.col("i") < F.col("n"))).withColumn("score", F.round(gain, 6)).filter("score > 0")
    return cuts.groupBy("read").agg(F.max_by("i", F.struct("score", -F.col("i"))).cast("long").alias("cut"), F.max("score").alias("score"))


def half_split_t(rows: DataFrame) -> DataFrame:
    """Welch's t and its degrees of freedom between both halves of a read, over all its positions; null where a half has no variance."""
    left = F.col("i") <= F.floor(F.col("n") / 2)
    pick = lambda f, side, name: f(F.when(side, F.col("p"))).alias(name)
    h = _placed(rows).groupBy("read").agg(F.max("n").alias("n"), *[pick(f, side, f"{k}{s}") for s, side in (("l", left), ("r", ~left)) for k, f in (("m", F.avg), ("v", F.var_pop), ("n", F.count))])
    h = h.withColumns({"el": F.try_divide("vl", "nl"), "er": F.try_divide("vr", "nr")})
    both = F.col("el") + F.col("er")
    t = F.try_divide(F.col("ml") - F.col("mr"), F.sqrt(both))
    part = lambda e, n: F.try_divide(F.col(e) * F.col(e), F.col(n) - 1)
    return h.select("read", "n", t.alias("t"), F.try_divide(both * both, part("el", "nl") + part("er", "nr")).alias("dof"))
