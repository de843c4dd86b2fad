"""A linear-chain conditional random field in numpy, trained and decoded in batches."""

from __future__ import annotations

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class ChainCRF:
    """Labels sequences whose items carry dense values and hashed sparse features.

    Each occurrence of a sparse feature carries a value that its weight is
    multiplied with.
    """

    def __init__(self, labels: int, dense: int, buckets: int) -> None:
        self.dense = np.zeros((dense, labels), np.float32)
        self.sparse = np.zeros((buckets, labels), np.float32)
        self.step = np.zeros((labels, labels), np.float32)
        self.labels = labels

    def emissions(self, dense: np.ndarray, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of every item; ``ids[starts[i]:starts[i+1]]`` are the features of item i."""
        scores = dense @ self.dense
        if len(ids):
            filled = np.flatnonzero(np.diff(starts))
            scores[filled] += np.add.reduceat(self.sparse[ids] * values[:, None], starts[filled], axis=0)
        return scores

    def _padded(self, scores: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longest = int(lengths.max())
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = np.arange(longest)[None, :]
        inside = place < lengths[:, None]
        at = np.minimum(offsets[:, None] + place, len(scores) - 1)
        return np.where(inside[:, :, None], scores[at], 0), inside

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of all items, by Viterbi; sequences of like length are decoded together."""
        out = np.zeros(len(scores), np.int8)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        for n in np.unique(lengths):
            if n == 0:
                continue
            rows = np.flatnonzero(lengths == n)
            e = scores[offsets[rows][:, None] + np.arange(n)]
            best, back = e[:, 0], []
            for t in range(1, n):
                through = best[:, :, None] + self.step
                back.append(through.argmax(1))
                best = through.max(1) + e[:, t]
            tag = best.argmax(1)
            out[offsets[rows] + n - 1] = tag
            for t in range(n - 2, -1, -1):
                tag = np.take_along_axis(back[t], tag[:, None], 1)[:, 0]
                out[offsets[rows] + t] = tag
        return out

    def fit(
        self,
        dense: np.ndarray,
        ids: np.ndarray,
        values: np.ndarray,
        starts: np.ndarray,
        lengths: np.ndarray,
        gold: np.ndarray,
        epochs: int = 12,
        batch: int = 256,
        rate: float = 0.05,
        decay: float = 1e-5,
        seed: int = 3,
    ) -> None:
        """Maximum likelihood by Adam on the exact gradient (forward-backward)."""
        rng = np.random.default_rng(seed)
        offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (self.dense, self.sparse, self.step)]
        tick = 0
        for _ in range(epochs):
            order = rng.permutation(len(lengths))
            for b in range(0, len(order), batch):
                rows = order[b : b + batch]
                n = lengths[rows]
                items = np.concatenate([np.arange(offsets[r], offsets[r] + k) for r, k in zip(rows, n, strict=True)])
                counts = starts[items + 1] - starts[items]
                part_starts = np.concatenate([[0], np.cumsum(counts)])
                where = np.repeat(starts[items] - part_starts[:-1], counts) + np.arange(part_starts[-1])
                part_ids, part_values = ids[where], values[where]
                scores = self.emissions(dense[items], part_ids, part_values, part_starts)
                e, inside = self._padded(scores, n)
                longest = e.shape[1]
                fwd = np.zeros_like(e)
                fwd[:, 0] = e[:, 0]
                for t in range(1, longest):
                    fwd[:, t] = _logsumexp(fwd[:, t - 1][:, :, None] + self.step, 1) + e[:, t]
                bwd = np.zeros_like(e)
                for t in range(longest - 2, -1, -1):
                    nxt = _logsumexp(self.step + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
                    bwd[:, t] = np.where(inside[:, t + 1][:, None], nxt, 0)
                total = _logsumexp(fwd[np.arange(len(rows)), n - 1], 1)
                belief = np.exp(fwd + bwd - total[:, None, None])
                flat = belief[inside]
                truth = np.eye(self.labels, dtype=np.float32)[gold[items]]
                error = (truth - flat).astype(np.float32)
                g_dense = dense[items].T @ error
                g_sparse = np.zeros_like(self.sparse)
                for label in range(self.labels):
                    g_sparse[:, label] = np.bincount(part_ids, np.repeat(error[:, label], counts) * part_values, len(g_sparse))
                g_step = np.zeros_like(self.step)
                for t in range(1, longest):
                    live = inside[:, t]
                    pair = np.exp(
                        fwd[live, t - 1][:, :, None]
                        + self.step
                        + (e[live, t] + bwd[live, t])[:, None, :]
                        - total[live][:, None, None]
                    )
                    g_step -= pair.sum(0)
                same = np.flatnonzero(np.diff(np.repeat(np.arange(len(rows)), n)) == 0)
                np.add.at(g_step, (gold[items][same], gold[items][same + 1]), 1)
                tick += 1
                for w, g, (m, v) in zip((self.dense, self.sparse, self.step), (g_dense, g_sparse, g_step), moments, strict=True):
                    g = g / len(rows) - decay * w
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w += rate * (m / (1 - 0.9**tick)) / (np.sqrt(v / (1 - 0.999**tick)) + 1e-8)
