"""Scalar and aggregate numeric functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def add_arrays(a: Column, b: Column) -> Column:
    """Element by element; arrays of different lengths are an error."""
    ok = F.assert_true(F.size(a) == F.size(b), "arrays of different lengths")
    return F.when(ok.isNull(), F.zip_with(a, b, lambda x, y: x + y))


def index_of(values: Column, value: Column) -> Column:
    """First index from 0 of an equal element, else -1."""
    return F.array_position(values, value) - 1


def factorial_double(n: Column) -> Column:
    """n! as a double, 1 for n below 2; beyond 170 it is infinite."""
    steps = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    return F.aggregate(steps, F.lit(1.0), lambda acc, k: acc * k)


def gamma_int(n: Column) -> Column:
    return factorial_double(n - 1)


# Coefficients of a published rational approximation of erf (Abramowitz and Stegun 7.1.26).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_ERF_P = 0.3275911


def erf(z: Column) -> Column:
    """Error function, within 1.5e-7."""
    x = F.abs(z)
    t = F.lit(1.0) / (1.0 + _ERF_P * x)
    poly = F.lit(0.0)
    for c in reversed(_ERF):
        poly = (poly + c) * t
    return F.signum(z) * (1.0 - poly * F.exp(-x * x))


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null if b is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))
