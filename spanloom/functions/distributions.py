"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: The coefficients of Lanczos' approximation of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Steps of the continued fraction; its error falls below 1e-12 in about the root of the larger parameter.
STEPS = 300


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x of 0.5 and more."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (y + k)
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(y + 7.5) - (y + 7.5) + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's forward recurrence."""
    tiny = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def half(acc: Column, term: Column) -> Column:
        # each half step: d and c are ratios of neighbouring denominators and numerators
        d, c = 1 / tiny(1 + term * acc["d"]), tiny(1 + term / acc["c"])
        return F.struct(d.alias("d"), c.alias("c"), (acc["h"] * d * c).alias("h"))

    let = lambda value, body: F.transform(F.array(value), body)[0]

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return let(half(acc, even), lambda s: half(s, odd))

    start = 1 / tiny(1 - (a + b) * x / (a + 1))
    begin = F.struct(start.alias("d"), F.lit(1.0).alias("c"), start.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), begin, step, lambda acc: acc["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a and b of 0.5 and more and x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = front * _fraction(a, b, x) / a
    high = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def student_p(t: Column, dof: Column) -> Column:
    """The probability that |t| is as large as this or larger; null for nulls and for dof under 1."""
    x = dof / (dof + t * t)
    return F.when(dof >= 1, incomplete_beta(dof / 2, F.lit(0.5), x))


def student_cdf(t: Column, dof: Column) -> Column:
    """The probability of a value up to ``t``."""
    half = student_p(t, dof) / 2
    return F.when(t > 0, 1 - half).otherwise(half)
