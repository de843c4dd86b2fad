"""All queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lotusflow.plans import chats, search, texts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    return {**search.QUERIES, **texts.QUERIES, **chats.QUERIES}


def oracle_sql() -> dict[str, str]:
    """Name to the SQL that gives the same rows."""
    return {**search.ORACLES, **texts.ORACLES, **chats.ORACLES}
