"""Column functions that Spark SQL lacks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients B(2k) / (2k (2k - 1)) of Stirling's series.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
SHIFT = 8
MINUS_INFINITY = float("-inf")


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series at x + 8, less the logarithm of x (x + 1) ... (x + 7)."""
    y = x + F.lit(float(SHIFT))
    inverse = F.lit(1.0) / y
    square = inverse * inverse
    series = F.lit(STIRLING[-1])
    for c in reversed(STIRLING[:-1]):
        series = series * square + F.lit(c)
    product = x
    for k in range(1, SHIFT):
        product = product * (x + F.lit(float(k)))
    return (y - F.lit(0.5)) * F.ln(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series * inverse - F.ln(product)


def log_or_inf(x: Column) -> Column:
    """ln(x), and minus infinity where x is 0 (Spark's own gives null)."""
    return F.when(x == 0, F.lit(MINUS_INFINITY)).otherwise(F.ln(x))


def log_of(p: float) -> float:
    return math.log(p) if p > 0 else MINUS_INFINITY
