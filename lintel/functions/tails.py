"""Tail probabilities as column expressions.

The regularised incomplete beta function is a continued fraction (modified
Lentz steps) folded over a sequence whose length follows the parameters, so
that one expression holds for any degrees of freedom; t and F tail
probabilities follow from it, and quantiles by Newton steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 10           # log-gamma is taken this far up, where Stirling's series is exact to 1e-12
TINY = 1e-300
NEWTON = 8


def _d(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("double")


def log_gamma(z) -> Column:
    """ln Γ(z), z > 0."""
    z = _d(z)
    w = z + SHIFT
    low = z
    for k in range(1, SHIFT):
        low = low * (z + k)
    v = 1 / (w * w)
    series = (1 / 12 - v * (1 / 360 - v * (1 / 1260 - v * (1 / 1680 - v / 1188)))) / w
    return (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + series - F.log(low)


def beta_inc(a, b, x, y) -> Column:
    """I_x(a, b) for 0 <= x <= 1 with ``y`` = 1 - x given apart, as it may be too small to subtract."""
    a, b, x, y = _d(a), _d(b), _d(x), _d(y)
    flip = x > (a + 1) / (a + b + 2)       # the fraction converges fast on this side of the mean
    sides = F.struct(F.when(flip, b).otherwise(a).alias("a"), F.when(flip, a).otherwise(b).alias("b"),
                     F.when(flip, y).otherwise(x).alias("x"), F.when(flip, x).otherwise(y).alias("y"))
    steps = F.sequence(F.lit(1), F.ceil(60 + 4 * F.sqrt(F.greatest(a, b))).cast("int"))

    def state(s, c, d, h):
        return F.struct(*[s[n].alias(n) for n in "abxy"], c.alias("c"), d.alias("d"), h.alias("h"))

    def start(s):
        d = 1 / _safe(1 - (s["a"] + s["b"]) * s["x"] / (s["a"] + 1))
        return state(s, F.lit(1.0), d, d)

    def step(s, k):
        c, d = _safe(1 + k / s["c"]), 1 / _safe(1 + k * s["d"])
        return state(s, c, d, s["h"] * c * d)

    def both(s, m):
        m = m.cast("double")
        p, q, v = s["a"], s["b"], s["x"]
        odd = m * (q - m) * v / ((p + 2 * m - 1) * (p + 2 * m))
        even = -(p + m) * (p + q + m) * v / ((p + 2 * m) * (p + 2 * m + 1))
        return _let(step(s, odd), lambda t: step(t, even))

    def finish(s):
        scale = (s["a"] * F.log(s["x"]) + s["b"] * F.log(s["y"]) + log_gamma(s["a"] + s["b"]) - log_gamma(s["a"])
                 - log_gamma(s["b"]))
        return F.exp(scale) * s["h"] / s["a"]

    value = _let(_let(sides, lambda s: F.aggregate(steps, start(s), both)), finish)
    return F.when(x <= 0, 0.0).when(y <= 0, 1.0).when(flip, 1 - value).otherwise(value)


def _safe(v: Column) -> Column:
    return F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)


def _let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), fn)[0]


def t_p_value(t, df) -> Column:
    """Two-sided tail probability of Student's t; NULL without degrees of freedom."""
    t, df = _d(t), _d(df)
    total = df + t * t
    return F.when((df > 0) & t.isNotNull(), beta_inc(df / 2, 0.5, df / total, t * t / total))


def f_p_value(f, df1, df2) -> Column:
    """Upper tail probability of F; NULL without degrees of freedom."""
    f, df1, df2 = _d(f), _d(df1), _d(df2)
    total = df2 + df1 * f
    return F.when((df1 > 0) & (df2 > 0) & (f >= 0), beta_inc(df2 / 2, df1 / 2, df2 / total, df1 * f / total))


def t_quantile(p: float, df) -> Column:
    """The quantile of Student's t at ``p`` (0.5 < p < 1); NULL without degrees of freedom."""
    df = _d(df)
    z = _normal_quantile(p)
    series = (z + (z ** 3 + z) / (4 * df) + (5 * z ** 5 + 16 * z ** 3 + 3 * z) / (96 * df * df))
    scale = log_gamma((df + 1) / 2) - log_gamma(df / 2) - 0.5 * F.log(df * math.pi)

    def newton(t, _):
        tail = t_p_value(t, df) / 2
        return t + (tail - (1 - p)) / F.exp(scale - (df + 1) / 2 * F.log1p(t * t / df))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), series.cast("double"), newton)
    return (F.when(df <= 0, F.lit(None)).when(df == 1, math.tan(math.pi * (p - 0.5)))
            .when(df == 2, (2 * p - 1) * math.sqrt(2 / (4 * p * (1 - p)))).otherwise(near))


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)
