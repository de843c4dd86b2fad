"""The best k rows of each query inside one task, in bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class BestK:
    """Keeps the k best (score, key) of each query; equal scores are ordered by key.

    Exactly k places are held for a query, whatever ties there are: a row that loses
    against k others by score and key loses against them everywhere. Keys are whole
    numbers or strings.
    """

    def __init__(self, queries: int, k: int, whole: bool) -> None:
        self.k, self.whole = k, whole
        self.score = np.full((queries, k), -np.inf)
        self.key = np.zeros((queries, k), np.int64) if whole else np.full((queries, k), "", dtype="U1")

    def add(self, first: int, scores: np.ndarray, keys: np.ndarray) -> None:
        """Scores of the queries ``first, first + 1, ...`` (rows) for rows ``keys`` (columns); -inf takes no part."""
        floor = self.score[first : first + len(scores), -1].copy()
        if scores.shape[1] > self.k:
            many = np.flatnonzero((scores >= floor[:, None]).sum(1) > self.k)
            if len(many):
                floor[many] = np.maximum(floor[many], -np.partition(-scores[many], self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
        if not len(r):
            return
        touched = np.unique(r)
        held = touched + first
        rows = np.concatenate([np.repeat(touched, self.k), r])
        value = np.concatenate([self.score[held].ravel(), scores[r, c]])
        name = np.concatenate([self.key[held].ravel(), keys[c]])
        order = np.lexsort((name, -value, rows))
        rows, value, name = rows[order], value[order], name[order]
        heads = np.flatnonzero(np.diff(rows, prepend=-1))
        best = np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows)))) < self.k
        if not self.whole and name.dtype.itemsize > self.key.dtype.itemsize:
            self.key = self.key.astype(name.dtype)
        self.score[held], self.key[held] = value[best].reshape(-1, self.k), name[best].reshape(-1, self.k)

    def table(self, names: pa.Array, key: str, key_type: pa.DataType) -> pa.RecordBatch:
        """``(query_id, key, score)`` of all places that are taken."""
        r, c = np.nonzero(self.score > -np.inf)
        keys = self.key[r, c]
        made = pa.array(keys, key_type) if self.whole else pa.array(keys.tolist(), key_type)
        return pa.RecordBatch.from_arrays([names.take(pa.array(r)), made, pa.array(self.score[r, c])], names=["query_id", key, "score"])


def key_array(column: pa.Array, whole: bool) -> np.ndarray:
    """Keys as an array that can be sorted."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64) if whole else np.array(column.to_pylist(), dtype=str)
