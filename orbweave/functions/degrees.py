"""The degree rule of quasi-cliques."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def check_gamma(gamma: float) -> None:
    """Members are looked for within two steps, which only 0.5 <= gamma <= 1 allows."""
    if not 0.5 <= gamma <= 1:
        raise ValueError("gamma lies between 0.5 and 1")


def required(gamma: float, n: int) -> int:
    """The least degree of a member in a set of n."""
    return math.ceil(gamma * (n - 1) - EPSILON)


def required_column(gamma: float, n: Column) -> Column:
    return F.ceil(F.lit(gamma) * (n - 1) - EPSILON)
