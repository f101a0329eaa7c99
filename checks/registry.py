"""Collects registered queries together with their DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None) -> Callable[[Query], Query]:
        def keep(build: Query) -> Query:
            self.add(name, build, oracle)
            return build

        return keep

    def add(self, name: str, build: Query, oracle: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} registered twice")
        self.queries[name] = build
        if oracle is not None:
            self.oracles[name] = oracle
