"""Vector columns: every operand is cast to double before arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def same_length(a: Column, b: Column, value: Column) -> Column:
    """`value`, or an error where the vectors differ in length."""
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.concat(F.lit("vector lengths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))).cast("double"))


def _fold(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return same_length(a, b, _fold(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)))


def norm(v: Column) -> Column:
    return F.sqrt(_fold(F.transform(as_doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return same_length(a, b, _fold(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))))


def l2_normalize(v: Column) -> Column:
    """Divided by the Euclidean norm; a zero vector stays."""
    n = norm(v)
    return F.when(n == 0, as_doubles(v)).otherwise(F.transform(as_doubles(v), lambda x: x / n))


def require_dimension(v: Column, dim: int) -> Column:
    """The vector, or an error where it has another length (null is an error too)."""
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vector must have {dim} components, has "), F.coalesce(F.size(v).cast("string"), F.lit("none")))))


def has_dimension(v: Column, dim: int) -> Column:
    return F.coalesce(F.size(v) == dim, F.lit(False))
