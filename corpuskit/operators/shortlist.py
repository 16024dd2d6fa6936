"""Per-task short lists: the running top-k of every query while batches stream by."""

from __future__ import annotations

import numpy as np


class ShortLists:
    """Keeps, per query, the k entries with the smallest (cost, id)."""

    def __init__(self, keys: list, k: int | None):
        self.keys, self.k = keys, k
        self.costs = [np.empty(0)] * len(keys)
        self.ids = [None] * len(keys)

    def add(self, j: int, costs: np.ndarray, ids: np.ndarray) -> None:
        if not costs.size:
            return
        if self.k is not None and costs.size > self.k:  # entries tied with the k-th stay in
            keep = costs <= np.partition(costs, self.k - 1)[self.k - 1]
            costs, ids = costs[keep], ids[keep]
        if self.ids[j] is not None:
            costs, ids = np.concatenate([self.costs[j], costs]), np.concatenate([self.ids[j], ids])
        order = np.lexsort((ids, costs))[: self.k]
        self.costs[j], self.ids[j] = costs[order], ids[order]

    def rows(self):
        """(query_id, id, cost) columns of everything kept."""
        filled = [j for j, ids in enumerate(self.ids) if ids is not None]
        keys = [self.keys[j] for j in filled for _ in range(self.ids[j].size)]
        ids = [i for j in filled for i in self.ids[j].tolist()]
        costs = [float(c) for j in filled for c in self.costs[j]]
        return keys, ids, costs


def comparable_ids(column) -> np.ndarray:
    """Arrow ids as an array that sorts the way Spark sorts them."""
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def open_rows(asked: list, listed) -> dict:
    """Jurisdiction -> mask of the rows open to it. `listed`: Arrow list column."""
    import pyarrow.compute as pc

    named = {a for a in asked if a is not None}
    if not named:
        return {}
    free = pc.is_null(listed).to_numpy(zero_copy_only=False)
    lengths = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(listed)), lengths)
    values = listed.flatten().to_numpy(zero_copy_only=False)
    masks = {}
    for a in named:
        masks[a] = free.copy()
        masks[a][owner[values == a]] = True
    return masks
