"""Named queries over the derived corpus, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.plans.corpus import Corpus, duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(corpus) -> DataFrame`` under its own name."""
    def wrap(fn: Callable[[Corpus], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: fn(Corpus(spark, folder))
        if sql is not None:
            ORACLES[key] = duck(sql)
        return fn
    return wrap
