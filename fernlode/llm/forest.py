"""Forest of random-projection trees, searched through one priority queue over all trees."""

from __future__ import annotations

import numpy as np


class Forest:
    """Balanced trees of one depth, fitted on a sample of unit vectors.

    A node splits by the direction between two of its sample vectors, at the median of their
    projections. Node n has the children 2n+1 and 2n+2.
    """

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        nodes, dim = 2**depth - 1, sample.shape[1]
        self.trees, self.depth, self.dim = trees, depth, dim
        self.normals = np.zeros((trees * nodes, dim), np.float32)
        self.cuts = np.zeros(trees * nodes, np.float32)
        self.nodes = nodes
        for t in range(trees):
            parts = [np.arange(len(sample))]
            for level in range(depth):
                split = []
                for k, rows in enumerate(parts):
                    n = t * nodes + 2**level - 1 + k
                    for _ in range(3):
                        if len(rows) < 2:
                            break
                        a, b = sample[rng.choice(rows, 2, replace=False)]
                        normal = a - b
                        if (size := np.linalg.norm(normal)) > 1e-6:
                            break
                    else:
                        size = 0.0
                    if len(rows) < 2 or size <= 1e-6:  # too few to tell: a direction by chance
                        normal = rng.standard_normal(dim)
                        size = np.linalg.norm(normal)
                    self.normals[n] = normal / size
                    if len(rows):
                        p = sample[rows] @ self.normals[n]
                        self.cuts[n] = np.median(p)
                        right = p > self.cuts[n]
                        split += [rows[~right], rows[right]]
                    else:
                        split += [rows, rows]
                parts = split

    def route(self, vectors: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(home, visited, reach): leaf numbers of shape (n, trees) and (n, visits), and how far the
        vector lies from the splits that part it from each visited leaf.

        Every vector lives in one leaf of each tree. The queue of a vector holds the other sides of
        the nodes that it passed, in all trees, by the largest distance to a split on the way;
        `visits` times the nearest is taken, descended, and its own other sides join the queue.
        """
        n, depth, trees = len(vectors), self.depth, self.trees
        home = np.zeros((n, trees), np.int64)
        wide = trees * depth + visits * depth
        far = np.full((n, wide), np.inf, np.float32)
        node = np.zeros((n, wide), np.int64)  # the other side, as tree * nodes' numbering below the split
        where = np.zeros(n, np.int64)
        every = np.arange(n)
        for t in range(trees):
            where[:] = 0
            for level in range(depth):
                m = np.einsum("ij,ij->i", vectors, self.normals[t * self.nodes + where]) - self.cuts[t * self.nodes + where]
                right = m > 0
                far[:, t * depth + level] = np.abs(m)
                node[:, t * depth + level] = (2 * where + 1 + ~right) * trees + t
                where = 2 * where + 1 + right
            home[:, t] = (where - self.nodes) * trees + t
        visited = np.zeros((n, visits), np.int64)
        reached = np.full((n, visits), np.inf, np.float32)
        for v in range(visits):
            best = far.argmin(axis=1)
            reach = far[every, best]
            reached[:, v] = reach
            far[every, best] = np.inf
            at = node[every, best]
            tree, where = at % trees, at // trees
            base = (trees + v) * depth
            for level in range(depth):
                on = np.flatnonzero(where < self.nodes)
                if not len(on):
                    break
                g = tree[on] * self.nodes + where[on]
                m = np.einsum("ij,ij->i", vectors[on], self.normals[g]) - self.cuts[g]
                right = m > 0
                far[on, base + level] = np.maximum(np.abs(m), reach[on])
                node[on, base + level] = (2 * where[on] + 1 + ~right) * trees + tree[on]
                where[on] = 2 * where[on] + 1 + right
            visited[:, v] = (where - self.nodes) * trees + tree
        return home, visited, reached
