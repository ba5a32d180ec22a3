"""Analysis windows as constant arrays. Framewise features use the symmetric Hann window, spectrograms the periodic one."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def hann_symmetric(n: int) -> list[float]:
    return [0.5 * (1 - math.cos(2 * math.pi * i / (n - 1))) if n > 1 else math.nan for i in range(n)]


def hann_periodic(n: int) -> list[float]:
    return [0.5 * (1 - math.cos(2 * math.pi * i / n)) for i in range(n)]


def gaussian(n: int) -> list[float]:
    """Gaussian over [-1, 1] with standard deviation 1 / sqrt(12 ln 10)."""
    sigma = 1 / math.sqrt(12 * math.log(10))
    return [math.exp(-0.5 * ((2 * i / (n - 1) - 1) / sigma) ** 2) if n > 1 else 1.0 for i in range(n)]
