"""Registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from mnemospark.sources.storage import owner

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def settle_ties(sql: str) -> str:
    """round(x, n) -> round(x + 1e-10, n): decimal ties round alike in every engine (see ``scores.rounded``)."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, comma, i = 1, None, at + 6
        while depth:
            c = sql[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = i
            i += 1
        if comma is not None:
            sql = f"{sql[:comma]} + 1e-10{sql[comma:]}"
        at += 6
    return sql


def query(name: str, sql: str | None = None):
    """Registers f(spark, sf_dir) under a name, with DuckDB SQL for the same rows where there is one; its result owns what is staged for it."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = owner(f)
        if sql:
            ORACLES[name] = settle_ties(sql)
        return f

    return put
