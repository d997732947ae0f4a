"""Vector arithmetic as column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column, norm_a: str | Column | None = None, norm_b: str | Column | None = None) -> Column:
    """Cosine similarity; 0 where a vector is zero. Norms can be given when they were computed before."""
    na, nb = (F.col(n) if isinstance(n, str) else n for n in (norm_a if norm_a is not None else norm(a), norm_b if norm_b is not None else norm(b)))
    return F.coalesce(F.try_divide(dot(a, b), na * nb), F.lit(0.0))


def negate(a: str | Column) -> Column:
    return F.transform(a, lambda x: -x)


def fuzzy_match(x: str | Column, w: str | Column) -> Column:
    """sum(min(x, w)) / sum(x), the match function of fuzzy ART."""
    low = F.aggregate(F.zip_with(x, w, lambda a, b: F.least(a, b)), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(low, F.aggregate(x, F.lit(0.0), lambda s, v: s + v)), F.lit(0.0))
