"""Links found inside one task, reduced to a spanning forest."""

from __future__ import annotations

import numpy as np


class Forest:
    """Components of 0 .. n-1 as a flat label array; ``link`` keeps one edge for each merge, so n - 1 at most in all."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        """Links of node ``i`` to each of ``others``."""
        labels, where = np.unique(self.label[others], return_index=True)
        new = labels != self.label[i]
        if not new.any():
            return
        self.edges += [(i, int(others[w])) for w in where[new]]
        merged = np.append(labels[new], self.label[i])
        self.label[np.isin(self.label, merged)] = merged.min()
