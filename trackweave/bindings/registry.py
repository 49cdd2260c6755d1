"""Registered queries, each next to the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Run
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a query; without SQL it is tested against brute force in ``tests``."""

    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = Registered(run, sql)
        return run

    return add
