"""All core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timberline.plans import problems, reference, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference.queries() | problems.queries()


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
