"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotusflow.runtime import arrow_map, materialize, shared_dir, spread  # noqa: F401

#: A text counts as present when it has at least one letter or digit.
HAS_TEXT = r"[\p{L}\p{N}]"

#: Java character class of everything that is not Unicode white space.
NOT_SPACE = r"[^\p{IsWhite_Space}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the project's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def has_text(column: Column) -> Column:
    """True when the text holds a letter or digit; null and blank texts give false."""
    return F.coalesce(column.rlike(HAS_TEXT), F.lit(False))


def distinct_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df.distinct()`` that moves only rows whose key occurs more than once.

    The keys that occur more than once are written to the shared folder first, so
    Spark knows their size and broadcasts them where they are few; beyond that it
    joins by shuffle.
    """
    many = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*[F.col(k).alias(f"{k}_many") for k in keys]))
    same = [df[k].eqNullSafe(many[f"{k}_many"]) for k in keys]
    return df.join(many, same, "left_anti").unionByName(df.join(many, same, "left_semi").distinct())


def sorted_groups(
    batches: Iterator[pa.RecordBatch], keys: list[str]
) -> Iterator[pa.Table]:
    """Split a partition that is sorted by ``keys`` into one Arrow table per key.

    Only the rows of the current key are held; everything else streams.
    """
    pending: list[pa.Table] = []
    current: tuple | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[start]:
                continue
            part = pa.Table.from_batches([batch.slice(start, i - start)])
            if current is not None and marks[start] != current:
                yield pa.concat_tables(pending)
                pending = []
            current = marks[start]
            pending.append(part)
            start = i
    if pending:
        yield pa.concat_tables(pending)

