"""Filters and projections over memory tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_text(column: str | Column, text: str) -> Column:
    """Case-insensitive containment; % and _ of the text are ordinary characters."""
    return F.contains(F.lower(column), F.lit(text.lower()))


def keyword_search(entities: DataFrame, text: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """Rows with the text in any of the columns, most accessed first (ties by id)."""
    hits = entities.where(reduce(Column.__or__, [contains_text(c, text) for c in columns]))
    hits = hits.orderBy(F.desc("access_count"), "id")
    return hits if limit is None else hits.limit(limit)


def min_confidence(df: DataFrame, threshold: float, column: str = "confidence") -> DataFrame:
    return df.where(F.coalesce(F.col(column), F.lit(0.0)) >= threshold)


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Inclusive range; an open end where a bound is None."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def extract(df: DataFrame, field: str) -> DataFrame:
    return df.select(field).dropna()


def valid_at(df: DataFrame, t, start: str = "valid_from", end: str = "valid_until") -> DataFrame:
    """Rows valid at t: start <= t < end, with no end for null."""
    t = F.lit(t)
    return df.where((F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t)))


def conjunction(df: DataFrame, **bounds) -> DataFrame:
    """Keeps rows that meet all bounds: name_min, name_max, name_in or name (equality); None is no bound."""
    for key, value in bounds.items():
        if value is None:
            continue
        if key.endswith("_min"):
            df = df.where(F.col(key[:-4]) >= value)
        elif key.endswith("_max"):
            df = df.where(F.col(key[:-4]) <= value)
        elif key.endswith("_in"):
            df = df.where(F.col(key[:-3]).isin(*value))
        else:
            df = df.where(F.col(key) == value)
    return df


def meant_for(df: DataFrame, member: str, column: str) -> DataFrame:
    """Rows whose list names the member; an empty or missing list means everyone."""
    return df.where(F.col(column).isNull() | (F.size(column) == 0) | F.array_contains(column, member))


def issues(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in their order."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
