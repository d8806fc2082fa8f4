"""Collects named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .roles import ROLES, role, table, with_roles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """What a query reads: ``i.cards`` is the role, ``i.part`` the driver's table."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return role(self.spark, self.sf_dir, name) if name in ROLES else table(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None):
    """Register a function of Inputs under a unique name, with DuckDB SQL over roles and tables."""

    def add(f: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[name] = with_roles(oracle)
        return f

    return add
