"""Vector expressions with single-precision results in index order: half-precision rounding, dot product, norm, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT0 = lambda: F.lit(0.0).cast("float")
HALF_MAX = 65504.0


def to_half(x: Column) -> Column:
    """x rounded to the nearest binary16 value (ties to even), as a float; beyond the range it is infinite."""
    d = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(d))), F.lit(-14)) - 10)
    rounded = F.rint(d / step) * step
    return F.when((d == 0) | F.isnan(d) | (F.abs(d) == float("inf")), d).when(F.abs(rounded) > HALF_MAX, F.signum(d) * F.lit(float("inf"))).otherwise(rounded).cast("float")


def half_vector(v: Column) -> Column:
    return F.transform(v, to_half)


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter length, folded from the left in single precision."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y), FLOAT0(), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, FLOAT0(), lambda s, x: s + x * x).cast("double")).cast("float")


def cosine(query: Column, vector: Column, vector_norm: Column) -> Column:
    """Of a unit query with a stored vector of known norm; 0 for a zero vector."""
    return F.when(vector_norm == 0, FLOAT0()).otherwise((dot(query, vector).cast("double") / vector_norm.cast("double")).cast("float"))


def masked_mean(value: Column, mask: Column) -> Column:
    """Mean over a group's rows whose mask is not 0; 0 if all are masked."""
    return F.coalesce(F.avg(F.when(mask != 0, value)), F.lit(0.0))
