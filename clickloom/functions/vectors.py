"""Vector expressions over ARRAY columns; they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once; an expression named inside a lambda is computed per element."""
    return F.transform(F.array(value), use)[0]


def unit(v: Column | str) -> Column:
    """L2-normalised copy; a zero vector stays as it is."""
    scaled = lambda a, n: F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)
    return _once(doubles(v), lambda a: _once(norm(a), lambda n: scaled(a, n)))


def pad(v: Column | str, dim: int) -> Column:
    v = _c(v)
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(v), F.lit(0))))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def project_user(v: Column | str, total_dim: int) -> Column:
    """Factor vector placed on the first axes of the item space, then normalised."""
    return unit(pad(doubles(v), total_dim))


def is_zero(v: Column | str) -> Column:
    return ~F.exists(_c(v), lambda x: x != 0)
