"""The cache of rewritten queries as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import CACHE_DAYS
from lotusflow.operators.indexing import upsert


def fresh(cache: DataFrame, now: Column, days: int | None = CACHE_DAYS) -> DataFrame:
    """Entries that are not older than ``days``; without a limit all of them."""
    return cache if days is None else cache.where(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(days)))


def expired(cache: DataFrame, now: Column, days: int = CACHE_DAYS) -> DataFrame:
    """Entries that an expiry removes; ``fresh`` keeps the others, an empty selection clears the cache."""
    return cache.where(F.col("created_at") < now - F.make_dt_interval(days=F.lit(days)))


def lookup(requests: DataFrame, cache: DataFrame, now: Column, model: str, version: str, days: int | None = CACHE_DAYS) -> DataFrame:
    """Requests ``(raw_query)`` with ``cache_key`` and the cached columns, null where there is no fresh entry."""
    keyed = requests.withColumn("cache_key", T.cache_key(F.lit(model), F.lit(version), F.col("raw_query")))
    return keyed.join(fresh(cache, now, days).drop("raw_query"), "cache_key", "left")


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The cache with new entries, each replacing the one of its key."""
    return upsert(cache, entries, ["cache_key"])
