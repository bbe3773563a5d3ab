"""Student-t tail areas and quantiles as column expressions, for a handful of summary rows.

The two-sided tail area of t with df degrees of freedom is the regularised incomplete beta
function at df / (df + t^2) with parameters df / 2 and 1 / 2.  It is evaluated by its continued
fraction (modified Lentz steps), taken on the side where it converges fast, as an ``aggregate``
over a sequence whose length follows from the parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, functions as F

# Lanczos approximation of the gamma function, g = 7.
LANCZOS_G = 7
LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)
_TINY = 1e-300
#: Beyond this many degrees of freedom tails are taken from those with this many.
LARGE_DF = 1e5
#: Halvings of the interval of log2(t) in which a quantile is sought.
HALVINGS, LOWEST, HIGHEST = 64, -30.0, 50.0


def ln_gamma(z: Column) -> Column:
    """Log of the gamma function for z >= 1/2."""
    terms = F.transform(F.expr(f"array({', '.join(f'{c!r}D' for c in LANCZOS[1:])})"), lambda c, i: c / (z + i))
    series = F.aggregate(terms, F.lit(LANCZOS[0]), lambda a, b: a + b)
    t = z - 1 + (LANCZOS_G + 0.5)
    return 0.5 * F.ln(F.lit(2 * pi)) + (z - 0.5) * F.ln(t) - t + F.ln(series)


def _let(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """``body`` of a struct of named values: each is evaluated once, however often it is used."""
    named = F.struct(*[v.alias(name) for name, v in values.items()])
    return F.get(F.transform(F.array(named), body), F.lit(0))


def _apart_from_zero(v: Column) -> Column:
    return F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """Continued fraction of the incomplete beta function."""
    steps = F.sequence(F.lit(1), (60 + 6 * F.sqrt(F.greatest(a, b))).cast("int"))
    d0 = 1 / _apart_from_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def half(acc: Column, factor: Column) -> Column:
        c, d = _apart_from_zero(1 + factor / acc["c"]), 1 / _apart_from_zero(1 + factor * acc["d"])
        return _let({"c": c, "d": d}, lambda s: F.struct(s["c"], s["d"], (acc["h"] * s["d"] * s["c"]).alias("h")))

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let({"mid": half(acc, even), "odd": odd}, lambda s: half(s["mid"], s["odd"]))

    return F.aggregate(steps, start, step)["h"]


def _beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """Regularised incomplete beta function at x = 1 - y, for a and b of at least 1/2."""
    turned = x >= (a + 1) / (a + b + 2)  # there the fraction of the other tail converges faster
    pick = lambda p, q: F.when(turned, q).otherwise(p)

    def value(s: Column) -> Column:
        a, b, x, y = (s[c] for c in "abxy")
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.ln(x) + b * F.ln(y))
        part = F.when(x <= 0, F.lit(0.0)).otherwise(front * _fraction(a, b, x) / a)
        return F.when(s["turned"], 1 - part).otherwise(part)

    return _let({"a": pick(a, b), "b": pick(b, a), "x": pick(x, y), "y": pick(y, x), "turned": turned}, value)


def t_p_value(t: Column, df: Column) -> Column:
    """P(|T| > |t|); NULL unless df >= 1.

    Beyond ``LARGE_DF`` degrees of freedom t is first carried over to the value with that many
    degrees of freedom whose tail is the same up to terms in 1 / df^2.
    """
    size = F.abs(t).cast("double")
    carried = size * (1 + (1 / F.lit(LARGE_DF) - 1 / df) * (size * size + 1) / 4)
    given = {"t": F.when(df > LARGE_DF, carried).otherwise(size), "n": F.least(df.cast("double"), F.lit(LARGE_DF))}

    def tail(s: Column) -> Column:
        square, n = s["t"] * s["t"], s["n"]
        return _beta(n / 2, F.lit(0.5), n / (n + square), square / (n + square))

    return F.when((df >= 1) & t.isNotNull(), _let(given, tail))


def t_quantile(confidence: Column, df: Column) -> Column:
    """t with P(|T| < t) = confidence, by halving an interval of log2(t); NULL unless df >= 1."""
    widths = F.transform(F.sequence(F.lit(1), F.lit(HALVINGS)), lambda k: F.lit(HIGHEST - LOWEST) / F.pow(F.lit(2.0), k))

    def halve(low: Column, width: Column) -> Column:
        inside = 1 - t_p_value(F.pow(F.lit(2.0), low + width), df) < confidence
        return F.when(inside, low + width).otherwise(low)

    return F.when(df >= 1, F.pow(F.lit(2.0), F.aggregate(widths, F.lit(LOWEST), halve)))
