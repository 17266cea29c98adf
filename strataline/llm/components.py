"""Components inside one block, beside those of whole edge tables."""

from __future__ import annotations

import numpy as np

from ..operators.components import connected_components

__all__ = ["connected_components", "roots"]


def roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each row the least id that the edges reach."""
    order = np.argsort(ids, kind="stable")
    low = np.empty(len(ids), dtype=np.int64)
    low[order] = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[order[new]]
        if (new == low).all():
            return ids[order[low]]
        low = new
