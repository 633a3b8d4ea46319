"""Named queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fellwalk.plans.data import VIEW_SQL, Data

_QUERIES: dict[str, Callable[[Data], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Data], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return add


def with_views(sql: str) -> str:
    """Prepends the derived views that `sql` mentions."""
    used = [v for v in VIEW_SQL if re.search(rf"\b{v}\b", sql)]
    ctes = ",\n".join(f"{v} AS ({VIEW_SQL[v]})" for v in used)
    body = sql.strip()
    if not ctes:
        return body
    m = re.match(r"WITH(\s+RECURSIVE)?\s", body, re.I)
    if m:
        rec = "RECURSIVE " if m.group(1) else ""
        return f"WITH {rec}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Data(spark, str(sf_dir)))
    return {name: bind(fn) for name, fn in _QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in _ORACLES.items()}
