"""Register of named queries: a Spark callable and, where SQL can state it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casebook.sources.bindings import Bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the bound tables under ``name``."""

    def register(build: Callable[[Bindings], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Bindings(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
