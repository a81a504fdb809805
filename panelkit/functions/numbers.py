"""Numeric column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def lgamma(x: Column) -> Column:
    """log Gamma(x) for x > 0 by Stirling's series, after shifting x up by ten; null otherwise. Absolute error under 1e-12."""
    shift = sum((F.log(x + k) for k in range(1, 10)), F.log(x))
    z = x + 10
    w = 1 / (z * z)
    tail = (1 / z) * (1.0 / 12 - w * (1.0 / 360 - w * (1.0 / 1260 - w * (1.0 / 1680))))
    return F.when(x > 0, (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + tail - shift)


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
