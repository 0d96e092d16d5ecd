"""Registered queries, each with the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewrack.plans.standins import VIEWS, Tables, needed

MODULES = ("text", "catalogue", "telemetry", "grid", "sampling", "pixel", "evaluation", "learning", "stream")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Put the definitions of all views a statement reads in front of it."""
    body = sql.strip()
    heads = [f"{n} AS ({VIEWS[n].strip()})" for n in needed(body)]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if own:
        body = body[own.end():]
        return "WITH RECURSIVE " + ",\n".join([*heads, body])
    return ("WITH " + ",\n".join(heads) + "\n" + body) if heads else body


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = with_views(sql)
        return fn

    return add


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(f"tidewrack.plans.{m}")
    return dict(_QUERIES), dict(_SQL)
