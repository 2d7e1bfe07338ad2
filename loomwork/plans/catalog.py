"""The library's queries over the supplied tables, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.plans import accounts, files, jobs, limits, pooling, reviews, texts

FLAGSHIP = "quote_verification"
ALL = accounts.QUERIES | texts.QUERIES | jobs.QUERIES | reviews.QUERIES | limits.QUERIES | pooling.QUERIES | files.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql} | reviews.SQL
