"""The best rows of many rankings at once, kept by each task while its batches go by."""

from __future__ import annotations

import numpy as np


class Best:
    """The ``k`` best of each of ``n`` rankings: the highest scores, ties by the lesser id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.at, self.ids, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def add(self, ids: np.ndarray, scores: np.ndarray, least: float = -np.inf, of: np.ndarray | None = None) -> None:
        """``scores``: a row for each ranking (or for those of the numbers ``of``), a column for each id; only those above ``least``
        count."""
        good = scores > least
        if scores.shape[1] > 2 * self.k:
            good &= scores >= np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k][:, None]
        row, column = np.nonzero(good)
        at = np.concatenate([self.at, row if of is None else of[row]])
        found, values = np.concatenate([self.ids, ids[column]]), np.concatenate([self.scores, scores[row, column]])
        order = np.lexsort((found, -values, at))
        place = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        keep = order[place < self.k]
        self.at, self.ids, self.scores = at[keep], found[keep], values[keep]
