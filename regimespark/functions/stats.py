"""Distribution functions that Spark lacks, on single numbers and as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def normal_cdf(x: float) -> float:
    return NormalDist().cdf(x)


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    f, cc, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d or 1e-300)
        cc = 1 + term / cc or 1e-300
        f *= cc * d
        if abs(1 - cc * d) < 1e-15:
            break
    return front * (f - 1)


def student_cdf(t: float, df: float) -> float:
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def binomial_tail(wins: int, n: int, p: float = 0.5) -> float:
    """P(at least `wins` of n)."""
    return sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(wins, n + 1))


def normal_probability(x: Column) -> Column:
    """The normal distribution function as an expression: the series of odd powers over odd factorials, to 1e-15."""
    x = x.cast("double")
    near = F.greatest(F.lit(-9.0), F.least(F.lit(9.0), x))
    step = lambda a, i: F.struct((a["t"] * near * near / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * near * near / (2 * i + 1)).alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(150)), F.struct(near.alias("t"), near.alias("s")), step, lambda a: a["s"])
    value = 0.5 + total * F.exp(-near * near / 2) / math.sqrt(2 * math.pi)
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def student_probability(t: Column, df: Column) -> Column:
    """Student's distribution function for whole degrees of freedom as an expression: the finite sums of cosines."""
    t, df = t.cast("double"), df.cast("int")
    angle = F.atan(t / F.sqrt(df))
    square, odd = F.pow(F.cos(angle), 2), df % 2 == 1
    # terms of even df: 1, 1/2, 1*3/(2*4) ...; of odd df: 1, 2/3, 2*4/(3*5) ..., each times a power of the squared cosine
    terms = F.when(odd, F.floor((df - 1) / 2)).otherwise(F.floor(df / 2)).cast("int")
    factor = lambda i: F.when(odd, (2 * i) / (2 * i + 1)).otherwise((2 * i - 1) / (2 * i))
    step = lambda a, i: F.struct((a["t"] * factor(i) * square).alias("t"), (a["s"] + a["t"] * factor(i) * square).alias("s"))
    more = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(more, F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), step, lambda a: a["s"])
    two_sided = F.when(odd, (angle + F.when(terms > 0, F.sin(angle) * F.cos(angle) * total).otherwise(0.0)) * (2 / math.pi)).otherwise(F.sin(angle) * total)
    return 0.5 + two_sided / 2
