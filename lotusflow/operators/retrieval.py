"""Fusion of ranked legs and the retrieval facade."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotusflow.functions import text as T
from lotusflow.functions.fixed import FACTUAL_INTENTS, FUSED_TOP_K, LEG_TOP_K, RRF_K
from lotusflow.operators import bm25, dense


def payload_filter(filters: Mapping[str, object] | None) -> Column:
    """All equalities of ``filters``; none keeps everything, a missing value never matches."""
    conditions = [F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in (filters or {}).items()]
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def intent_filter(intent: Column, is_reference: Column) -> Column:
    """For questions of fact, only chunks outside the sections of references."""
    return F.when(intent.isin(FACTUAL_INTENTS), ~F.coalesce(is_reference, F.lit(False))).otherwise(F.lit(True))


def preprocess(queries: DataFrame) -> DataFrame:
    """Adds the normalized query, the default intent and that nothing came from the cache."""
    return queries.select(
        "*", T.normalize_query(F.col("query")).alias("rewritten_query"), F.lit("factual").alias("intent"), F.lit(False).alias("from_cache")
    )


def fuse(dense_leg: DataFrame, sparse_leg: DataFrame, key: str, rrf_k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``(query_id, key, rrf_score, dense_score, sparse_score, rank)``.

    Either leg may lack a text or be empty. Ties are ordered by key. ``top_k`` of 0 or none
    means the default.
    """
    legs = dense_leg.select("query_id", key, "rank", F.col("score").alias("dense_score"), F.lit(None).cast("double").alias("sparse_score")).unionByName(
        sparse_leg.select("query_id", key, "rank", F.lit(None).cast("double").alias("dense_score"), F.col("score").alias("sparse_score"))
    )
    fused = legs.groupBy("query_id", key).agg(
        F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("rrf_score"),
        F.max("dense_score").alias("dense_score"),
        F.max("sparse_score").alias("sparse_score"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (top_k or FUSED_TOP_K))


def with_content(ranked: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Adds ``content`` and ``title``; a missing text gives an empty content."""
    found = texts.select(key, F.col("content"), F.col("title"))
    return ranked.join(found, key, "left").withColumn("content", F.coalesce("content", F.lit("")))


def leg_payloads(dense_leg: DataFrame, sparse_leg: DataFrame, key: str) -> DataFrame:
    """``(query_id, key, metadata)`` of two legs: the payload of the dense one, or of the sparse one where that is missing or empty."""
    d = dense_leg.select("query_id", key, F.col("metadata").alias("_dense")).dropDuplicates(["query_id", key])
    s = sparse_leg.select("query_id", key, F.col("metadata").alias("_sparse")).dropDuplicates(["query_id", key])
    full = F.when(F.size("_dense") > 0, F.col("_dense"))
    return d.join(s, ["query_id", key], "full_outer").select("query_id", key, F.coalesce(full, "_sparse", "_dense").alias("metadata"))


class Retrieval:
    """Search over texts with vectors: ``(key, content, title, vector)`` and any payload columns."""

    def __init__(self, texts: DataFrame, key: str, dim: int) -> None:
        self.texts, self.key, self.dim = texts, key, dim

    def preprocess(self, queries: DataFrame) -> DataFrame:
        """See ``preprocess``."""
        return preprocess(queries)

    def search(self, queries: DataFrame, filters: Mapping[str, object] | None = None, top_k: int | None = None, leg_k: int = LEG_TOP_K) -> DataFrame:
        """Answer queries ``(query_id, query, vector)``; filters apply before either leg ranks."""
        keep = payload_filter(filters)
        asked = queries.withColumn("query", T.normalize_query(F.col("query")))
        sparse = bm25.search_texts(self.texts, self.key, "content", asked.select("query_id", "query"), leg_k, keep)
        near = dense.dense_search(self.texts.where(keep), self.key, "vector", asked.select("query_id", "vector"), self.dim, leg_k)
        return with_content(fuse(near, sparse, self.key, top_k=top_k), self.texts, self.key)
