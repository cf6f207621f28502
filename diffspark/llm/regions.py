"""The join inside one region of Jaccard space: pivots, their Voronoi cells, triangle windows, recursively and exactly."""

from __future__ import annotations

import numpy as np

#: Pivots of a region at most, sets to a pivot at least, and sets that are compared one by one.
PIVOTS, OF_PIVOT, DIRECT = 8, 3, 3
SLACK = 1e-9


class Region:
    """The sets of a region. Sets with equal labels are known to be of one class; links() adds what joins classes."""

    def __init__(self, sets: list[np.ndarray], labels: list[int], percent: int):
        self.sizes = np.array([len(s) for s in sets])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.mark = np.zeros(self.ids.max() + 1, bool)
        self.percent, self.reach = percent, 1 - percent / 100
        _, self.label = np.unique(labels, return_inverse=True)
        self.found: list[tuple[int, int]] = []

    def overlap(self, i: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of set i with others."""
        own = self.ids[self.starts[i] : self.ends[i]]
        self.mark[own] = True
        if len(others) == len(self.sizes):
            hits, starts = self.mark[self.ids], self.starts
        else:
            n = self.sizes[others]
            starts = np.cumsum(n) - n
            hits = self.mark[self.ids[np.arange(int(n.sum())) + np.repeat(self.starts[others] - starts, n)]]
        self.mark[own] = False
        return np.add.reduceat(hits, starts, dtype=np.int64)

    def compare(self, i: int, others: np.ndarray) -> np.ndarray:
        """Distances of set i from others; linked classes are joined."""
        both = self.overlap(i, others)
        union = self.sizes[i] + self.sizes[others] - both
        for j in others[100 * both >= self.percent * union].tolist():
            if self.label[i] != self.label[j]:
                self.found.append((i, j))
                self.label[self.label == self.label[j]] = self.label[i]
        return 1 - both / union

    def links(self) -> list[tuple[int, int]]:
        """Links, by place, that join all classes with a link between them. Afterwards label holds the classes."""
        cells = [np.arange(len(self.sizes))]
        while cells:
            cell = cells.pop()
            if len(cell) < 2 or (self.label[cell] == self.label[cell[0]]).all():
                continue
            if len(cell) <= DIRECT:
                self._each(cell, np.zeros((0, len(cell))))
                continue
            # distances from pivots spread over the cell; those within reach become one class with their pivot
            many = min(PIVOTS, len(cell) // OF_PIVOT)
            pivots = cell[:: len(cell) // many][:many]
            d = np.stack([self.compare(p, cell) for p in pivots.tolist()])
            rest = ~np.isin(cell, pivots)
            cell, d = cell[rest], d[:, rest]
            if (self.label[cell] == self.label[cell[0]]).all():
                continue
            # a cell's window: whatever may lie within reach of a set that is nearest to its pivot
            inside = d <= d.min(0) + 2 * self.reach + SLACK
            if (inside.sum(1) > 0.8 * len(cell)).any():  # not separable: pivots' bounds leave out what they can
                self._each(cell, d)
            else:
                cells += [cell[x] for x in inside]
        return self.found

    def _each(self, cell: np.ndarray, d: np.ndarray) -> None:
        """Compares sets of different classes, apart from pairs that distances from pivots or sizes rule out."""
        of, count = np.unique(self.label[cell], return_counts=True)
        order = np.argsort(self.label[cell] == of[count.argmax()], kind="stable")  # the largest class last
        cell, d, n = cell[order], d[:, order], self.sizes[cell[order]]
        for k, i in enumerate(cell.tolist()):
            later = cell[k + 1 :]
            open_ = self.label[later] != self.label[i]
            if not open_.any():
                continue
            open_ &= 100 * np.minimum(n[k], n[k + 1 :]) >= self.percent * np.maximum(n[k], n[k + 1 :])
            if len(d):
                open_ &= np.abs(d[:, k + 1 :] - d[:, k : k + 1]).max(0) <= self.reach + SLACK
            if open_.any():
                self.compare(i, later[open_])
