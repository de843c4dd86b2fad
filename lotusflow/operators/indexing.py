"""Incremental indexing, keyed upserts and collections of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_indexed(chunks: DataFrame, entries: DataFrame) -> DataFrame:
    """Chunks ``(id, ...)`` without an index entry ``(chunk_id, ...)``."""
    return chunks.join(entries.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def chunks_with_source(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``source_id`` to the chunks of known documents; a document of several sources gives its chunks to each."""
    return chunks.join(documents.select("document_id", "source_id").distinct(), "document_id")


def chunks_of_source(chunks: DataFrame, documents: DataFrame, source_id: str) -> DataFrame:
    """Chunks of the documents of one source."""
    return chunks_with_source(chunks, documents.where(F.col("source_id") == source_id)).select(*chunks.columns)


def chunks_by_id(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks whose id is among ``ids``; unknown ids give nothing."""
    return chunks.join(ids.select("id"), "id", "left_semi")


def with_payload(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``source_id`` and ``title`` of the document where it exists."""
    found = documents.select("document_id", "source_id", "title").dropDuplicates(["document_id"])
    return chunks.join(found, "document_id", "left")


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order given.

    Kept as a filter on the row number, so each partition drops all but its best
    row of a key before the shuffle; a key with a third of the rows costs no more.
    """
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_n") == 1).drop("_n")


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after the changes: a changed key takes all columns of its change.

    Keys must be unique within ``changes``; use ``latest`` before.
    """
    kept = table.join(changes.select(*keys), list(keys), "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def storable(entries: DataFrame, dim: int | None = None) -> DataFrame:
    """Entries with at least one vector, and where ``dim`` is given with none of another length."""
    some = entries.where(F.col("dense_vector").isNotNull() | F.col("sparse_vector").isNotNull())
    return some if dim is None else some.where(F.col("dense_vector").isNull() | (F.size("dense_vector") == dim))


def remove_keys(table: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows of some keys."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")
