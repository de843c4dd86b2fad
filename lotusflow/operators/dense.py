"""Exact dense search of a set of queries against all vectors.

The queries are compared in blocks: a bounded block of query vectors travels to
every partition, where matrix products of some hundred queries with some thousand
vectors keep the best k of each query; only those meet in the final ranking. More
queries than a block holds are answered by further passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotusflow.functions.fixed import LEG_TOP_K
from lotusflow.operators.topk import BestK, key_array
from lotusflow.runtime import arrow_map

#: Bytes of query vectors in one pass.
BLOCK_BYTES = 32 << 20

#: Queries and vectors of one matrix product.
ROWS, COLUMNS = 512, 4096


def cosine(a: str, b: str):
    """Cosine of two array columns as a JVM expression; null for a zero vector."""
    dot = F.aggregate(F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.try_divide(dot, norm(a) * norm(b))


def _usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    v = F.col(vector)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False)))


def check_dimension(df: DataFrame, vector: str, dim: int) -> None:
    """Fails if any non-null vector has another length."""
    wrong = df.where(F.col(vector).isNotNull() & (F.size(vector) != dim)).limit(1).count()
    if wrong:
        raise ValueError(f"vectors must have {dim} values")


def _score(names: pa.Array, queries: np.ndarray, key: str, key_type: pa.DataType, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.types.is_integer(key_type)
        best = BestK(len(queries), k, whole)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            keys = key_array(batch.column(key), whole)
            for i in range(0, len(x), COLUMNS):
                for q in range(0, len(queries), ROWS):
                    best.add(q, (queries[q : q + ROWS] @ x[i : i + COLUMNS].T).round(6), keys[i : i + COLUMNS])
        made = best.table(names, key, key_type)
        if made.num_rows:
            yield made

    return run


def dense_search(vectors: DataFrame, key: str, vector: str, queries: DataFrame, dim: int, k: int = LEG_TOP_K) -> DataFrame:
    """``(query_id, key, score, rank)``: the k vectors nearest to each query ``(query_id, vector)`` by cosine.

    Vectors and queries that are null, zero, hold NaN or have another length take
    no part, nor do null keys. Cosines count to 6 decimals; ties are ordered by key.
    """
    rows = _usable(vectors, vector, dim).where(F.col(key).isNotNull()).select(key, F.col(vector).alias("vector"))
    asked = _usable(queries, "vector", dim).select("query_id", "vector")
    kind = dict(rows.dtypes)[key]
    key_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(kind, pa.string())
    block = max(1, BLOCK_BYTES // (8 * dim))
    blocks = max(1, -(-asked.count() // block))
    passes = []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        held = part.toArrow().combine_chunks()
        if not held.num_rows:
            continue
        q = pa.concat_arrays(held.column("vector").chunks).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        names = pa.concat_arrays(held.column("query_id").chunks)
        passes.append(arrow_map(rows, _score(names, q, key, key_type, dim, k), f"query_id {dict(asked.dtypes)['query_id']}, `{key}` {kind}, score double"))
    if not passes:
        return rows.sparkSession.createDataFrame([], f"query_id {dict(asked.dtypes)['query_id']}, `{key}` {kind}, score double, rank int")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return reduce(DataFrame.unionByName, passes).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
