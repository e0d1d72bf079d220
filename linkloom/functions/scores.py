"""Scores as fixed-point integers.

Weights are summed as whole numbers of 1e-12, so a sum does not depend on the
order in which partitions arrive or on a task being run again.  They are
decimals of 38 digits, which hold any sum of scores; a caller that has proved
that its sums stay under LARGEST_SUM may cast them to 64 bits.  A finished
score is rounded half up to 9 digits with integer arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = 10**12
ROUNDING_STEP = 1000
#: Sums (as doubles) under this fit 64 bits, whatever the rounding of the doubles.
LARGEST_SUM = 9e18


def to_fixed(value: Column) -> Column:
    return F.round(value * F.lit(float(UNIT))).cast("decimal(38,0)")


def from_fixed(value: Column) -> Column:
    shifted = value + F.lit(ROUNDING_STEP // 2)
    return (shifted - shifted % F.lit(ROUNDING_STEP)).cast("double") / F.lit(float(UNIT))


def comparisons(n1: Column, n2: Column) -> Column:
    """Cross-collection comparisons of a block, as a double (no overflow)."""
    return n1.cast("double") * n2.cast("double")


def arcs_weight(n1: Column, n2: Column) -> Column:
    """Small blocks count more: ``1 / log2(1 + n1 * n2)``."""
    return F.lit(1.0) / F.log2(F.lit(1.0) + comparisons(n1, n2))


def idf(n_entities: Column, n_in_block: Column) -> Column:
    return F.log10(n_entities.cast("double") / n_in_block.cast("double"))


def harmonic_mean(a: Column, b: Column) -> Column:
    return F.try_divide(F.lit(2.0) * a * b, a + b)


def rank_score(factor: float, size: Column, rank: Column) -> Column:
    """``factor`` for the first of ``size`` candidates, falling linearly to ``factor / size``."""
    return F.lit(float(factor)) * (size - rank + F.lit(1)).cast("double") / size.cast("double")
