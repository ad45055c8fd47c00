"""Registered queries: one per operator, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from factspark.sources.tables import Tables, with_derived

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


def load() -> None:
    from . import (  # noqa: F401  (each module registers its queries)
        columns,
        intake,
        reads,
        gaps,
        totals,
        projections,
        checks,
        lifecycle,
        identity,
        streams,
    )


def queries():
    load()

    def bind(build):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, build in QUERIES.items()}


def oracle_sql():
    load()
    return {name: with_derived(sql) for name, sql in ORACLES.items()}
