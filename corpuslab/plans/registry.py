"""Registry of named queries: (spark, sf_dir) -> DataFrame, plus oracle SQL text."""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from corpuslab.session import released_with_result, ship_package
            ship_package(spark)
            return released_with_result(lambda: fn(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def oracle(name: str, sql: str) -> None:
    """Attach oracle SQL to an already registered query (for twins built
    from pieces defined after the query)."""
    if name not in QUERIES:
        raise KeyError(name)
    ORACLE_SQL[name] = sql


def load_all() -> None:
    """Import every module that registers queries."""
    from corpuslab.plans import corpus_queries  # noqa: F401
    for mod in ("score_queries", "report_queries", "runlog_queries",
                "inference_queries", "stream_queries", "io_queries"):
        try:
            __import__(f"corpuslab.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"corpuslab.plans.{mod}":
                raise
