"""Registered queries over the driver's tables, each beside the DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    from barflow.catalog import bars, evaluation, labels, ledgers, market, models, signals, storage, streams  # noqa: F401
