"""Sizes, hash counts and false-positive models of filters, as columns."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column | float) -> Column:
    return (F.lit(x) if isinstance(x, (int, float)) else x).cast("double")


def _padded(v: Column) -> Column:
    """Up to a multiple of 64; an exact multiple still gains 64."""
    v = F.floor(v).cast("bigint")
    return v + (F.lit(64) - F.pmod(v, F.lit(64)))


def optimal_size(n: Column, fpr: Column, h: Column) -> Column:
    return _padded(-_d(n) * _d(h) / F.log(1 - F.pow(_d(fpr), 1 / _d(h))))


def optimal_hashes(fpr: Column) -> Column:
    """0 for rates above one half."""
    return F.floor(-F.log(_d(fpr)) / F.lit(math.log(2.0))).cast("int")


def modelled_fpr(m: Column, n: Column, h: Column) -> Column:
    """After n inserted elements."""
    return F.pow(1 - F.pow(1 - 1 / _d(m), _d(n) * _d(h)), _d(h))


def optimal_fpr(h: Column) -> Column:
    """At the best size for h hashes."""
    return F.pow(F.lit(2.0), -_d(h))


#: Terms that redundancy_fpr adds one by one, and the nodes of each panel beyond them.
EXACT, NODES = 64, 12


def redundancy_fpr(m: Column, n: Column, h: Column) -> Column:
    """Mean false-positive rate over the insertions: f(1) for one, else the sum of f(1) to f(n - 1) over n.

    The first terms are added; the others, a smooth function, by the Euler-Maclaurin formula, whose integral is taken in
    panels that double. Some hundreds of terms in all, however large n is."""
    f = lambda x: modelled_fpr(m, x, h)
    # The derivative of f, as q^(h x) = exp(rate x).
    rate = _d(h) * F.log(1 - 1 / _d(m))
    slope = lambda x: -_d(h) * F.pow(1 - F.exp(rate * _d(x)), _d(h) - 1) * rate * F.exp(rate * _d(x))
    end = _d(n) - 1
    head = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.greatest(F.least(n.cast("bigint") - 1, F.lit(EXACT)), F.lit(1))), F.lit(0.0), lambda acc, i: acc + f(i))
    at, weight = np.polynomial.legendre.leggauss(NODES)

    def panel(acc: Column, j: Column) -> Column:
        low = F.lit(float(EXACT)) * F.pow(F.lit(2.0), _d(j))
        half = (F.least(low * 2, end) - low) / 2
        return acc + half * sum((F.lit(float(w)) * f(low + half * (1 + float(x))) for x, w in zip(at, weight)), F.lit(0.0))

    panels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(end / EXACT)).cast("int") - 1, F.lit(0)))
    first = F.lit(float(EXACT))
    tail = F.aggregate(panels, F.lit(0.0), panel) + (f(end) - f(first)) / 2 + (slope(end) - slope(first)) / 12
    return F.when(n == 1, f(F.lit(1))).otherwise((head + F.when(end > EXACT, tail).otherwise(0.0)) / _d(n))


def size_from_occupancy(n: Column, h: Column, occupancy: Column | float) -> Column:
    return _padded(-_d(n) * _d(h) / F.log(1 - _d(occupancy)))


def tool_size(n: Column, fpr: Column) -> Column:
    """The size the command-line writer takes for n elements."""
    v = F.ceil(-_d(n) * F.log(_d(fpr)) / F.lit(math.log(2.0) ** 2)).cast("bigint")
    return v + (F.lit(64) - F.pmod(v, F.lit(64)))


def tool_hashes(n: Column, m: Column) -> Column:
    return F.floor(_d(m) / _d(n) * F.lit(math.log(2.0))).cast("int")


def choose(n: int, k: int) -> int:
    return math.comb(n, k)


def frame_probability(occupancy: Column, h: int, freq: Column, misses: int = 0) -> Column:
    """Probability that a random frame matches an id of this frequency in at least h - misses slots."""
    total = F.lit(0.0)
    for i in range(h - misses, h + 1):
        total = total + F.lit(float(math.comb(h, i))) * F.pow(_d(occupancy), F.lit(float(i))) * F.pow(1 - _d(occupancy), F.lit(float(h - i))) * (1 - F.pow(1 - _d(freq), F.lit(float(i))))
    return total


def slot_probability(occupancy: Column, freq: Column) -> Column:
    return _d(occupancy) * _d(freq)


def _log_gamma(z: Column) -> Column:
    """Stirling's series, ten steps up from z."""
    x = z + 10
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    return series - F.log(math.prod([z + i for i in range(1, 10)], start=z))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method; good for x < (a + 1) / (a + b + 2), in
    some multiple of sqrt(a + b) steps."""
    tiny = F.lit(1e-300)
    safe = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def turn(s: Column, coefficient: Column) -> Column:
        d = 1 / safe(1 + coefficient * s["d"])
        c = safe(1 + coefficient / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["v"] * d * c).alias("v"))

    def step(s: Column, i: Column) -> Column:
        j = _d(i)
        s = turn(s, j * (b - j) * x / ((a + 2 * j - 1) * (a + 2 * j)))
        return turn(s, -(a + j) * (a + b + j) * x / ((a + 2 * j) * (a + 2 * j + 1)))

    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("v"))
    return F.aggregate(F.sequence(F.lit(1), (F.lit(60) + 4 * F.sqrt(a + b)).cast("int")), start, step, lambda s: s["v"])


def saturation_cdf(n: Column, p: Column, sat: Column) -> Column:
    """P(X <= sat - 1) for X binomial (n, p); 0 for sat = 0. As 1 - I_p(sat, n - sat + 1), the incomplete beta function, so that the
    steps grow with the root of n only."""
    n, p, sat = _d(n), _d(p), _d(sat)
    a, b = sat, n - sat + 1
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(p) + b * F.log(1 - p))
    low = p < (a + 1) / (a + b + 2)
    value = F.when(low, 1 - front * _beta_fraction(a, b, p) / a).otherwise(front * _beta_fraction(b, a, 1 - p) / b)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return F.when(sat <= 0, 0.0).when(p <= 0, 1.0).when(sat > n, 1.0).when(p >= 1, 0.0).otherwise(bounded)
