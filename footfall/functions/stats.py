"""Distribution functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos' approximation of the gamma function, g = 7. Fixed values.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def log_gamma(z: Column) -> Column:
    """The logarithm of the gamma function of a number of 0.5 or more."""
    x = z - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (x + i)
    t = x + 7.5
    return 0.5 * math.log(2 * math.pi) + (x + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function from its first term on, forwards by Lentz's products."""
    tiny = 1e-300

    def safe(v: Column) -> Column:
        return F.when(F.abs(v) < tiny, tiny).otherwise(v)

    def state(c: Column, d: Column, h: Column) -> Column:
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def turn(s: Column, number: Column) -> Column:
        d = 1 / safe(1 + number * s["d"])
        c = safe(1 + number / s["c"])
        return state(c, d, s["h"] * c * d)

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return turn(turn(s, even), odd)

    first = 1 / safe(1 - (a + b) * x / (a + 1))
    ms = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda m: m.cast("double"))
    return F.aggregate(ms, state(F.lit(1.0), first, first), step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, steps: int = 120) -> Column:
    """The regularised incomplete beta function of x in 0 to 1, for a and b from 0.5 to about 1,000."""
    turned = x > (a + 1) / (a + b + 2)
    y, p, q = (F.when(turned, u).otherwise(v) for u, v in ((1 - x, x), (b, a), (a, b)))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + p * F.ln(y) + q * F.ln(1 - y)) / p
    part = front * _fraction(y, p, q, steps)
    inner = F.when(turned, 1 - part).otherwise(part)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_two_sided(t: Column, freedom: Column) -> Column:
    """The probability that Student's t of so many degrees of freedom is as far from 0 as this or farther."""
    freedom = freedom.cast("double")
    return F.when(freedom > 0, incomplete_beta(freedom / (freedom + t * t), freedom / 2, F.lit(0.5)))
