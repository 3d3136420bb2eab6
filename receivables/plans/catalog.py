"""Query catalog: every registered query is ``(spark, sf_dir) -> DataFrame`` plus an optional DuckDB oracle.

Queries read the testdata tables through :class:`receivables.sources.fixtures.Fixtures`, so their work grows with
the data. Oracle SQL is written by hand against the same fixture views (prefixed as ``WITH`` clauses).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from receivables.sources.fixtures import Fixtures, duckdb_with

# Fixed evaluation dates for every fixture query.
AS_OF = dt.date(2001, 6, 30)
AS_OF_SQL = "DATE '2001-06-30'"
AUDIT_AS_OF = dt.datetime(2024, 1, 31)
AUDIT_AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


@dataclass
class Query:
    name: str
    build: Callable[[Fixtures], DataFrame]
    oracle: str | None
    item: str
    body: str = ""
    views: tuple[str, ...] = ()


REGISTRY: dict[str, Query] = {}


def register(name: str, item: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(fixtures) -> DataFrame``; ``oracle`` is the DuckDB body using fixture ``views``."""

    def deco(fn: Callable[[Fixtures], DataFrame]):
        sql = None
        if oracle is not None:
            body, prefix = oracle.strip(), duckdb_with(list(views))
            if prefix and body[:5].upper() == "WITH ":
                body = ",\n" + body[5:]
                prefix = prefix.rstrip("\n")
            sql = prefix + body
        REGISTRY[name] = Query(name, fn, sql, item, oracle or "", views)
        return fn

    return deco


class Swapped:
    """A Fixtures view of which some tables stand for others."""

    def __init__(self, fx: Fixtures, names: dict[str, str]):
        self._fx, self._names = fx, names

    def __getattr__(self, name: str):
        return getattr(self._fx, self._names.get(name, name))


def register_over(name: str, base: str, names: dict[str, str]) -> None:
    """Register query ``base`` once more over other fixture views (``names``: view -> view to use)."""
    q = REGISTRY[base]
    body = re.sub("|".join(rf"\b{n}\b(?!\.)" for n in names), lambda m: names[m.group()], q.body)
    views = tuple(names.get(v, v) for v in q.views)
    register(name, q.item, body, views)(lambda fx: q.build(Swapped(fx, names)))


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY[name].build(Fixtures.of(spark, sf_dir))


def load_all() -> dict[str, Query]:
    # Importing the query modules fills the registry.
    from receivables.plans import queries  # noqa: F401

    return REGISTRY
