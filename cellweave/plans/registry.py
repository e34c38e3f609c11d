"""All registered queries of the engine and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellweave.plans import files, forests, pixels, regions, tables


def _all() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    return {**tables.QUERIES, **pixels.QUERIES, **forests.QUERIES, **files.QUERIES, **regions.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
