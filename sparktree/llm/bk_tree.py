"""Many BK-trees at once, as arrays.

Each shard's codes form one tree: a node's children are keyed by their integer
Hamming distance to it, and a search within a radius follows, from a node at
distance d, only the edges d-radius to d+radius. All shards of a batch are built and
searched level by level together.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: Probes whose searches run together; with bounded shards this bounds the frontier.
PROBES = 4096


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """``code``: uint64 codes; ``shard``: the tree of each (non-negative, sorted).
    Codes of one shard must differ."""

    def __init__(self, code: np.ndarray, shard: np.ndarray):
        n = len(code)
        self.code = code
        first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if n else np.zeros(0, np.int64)
        self.shards = shard[first]
        self.roots = first
        parent = np.full(n, -1)
        edge = np.zeros(n, np.int64)
        at = np.repeat(first, np.diff(np.append(first, n)))
        left = np.setdiff1d(np.arange(n), first, assume_unique=True)
        while len(left):
            above = at[left]
            key = above * 128 + distance(code[left], code[above])
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            new = np.append(True, key[1:] != key[:-1])
            child = left[new]
            parent[child], edge[child] = key[new] // 128, key[new] % 128
            group = np.cumsum(new) - 1
            at[left] = child[group]
            left = np.sort(left[~new])
        inner = np.flatnonzero(parent >= 0)
        key = parent[inner] * 128 + edge[inner]
        order = np.argsort(key)
        self.edges, self.children = key[order], inner[order]

    def search(self, code: np.ndarray, shard: np.ndarray, radius: int):
        """Yield (probes, nodes) within ``radius``, for probes in blocks."""
        place = np.searchsorted(self.shards, shard)
        known = place < len(self.shards)
        known[known] = self.shards[place[known]] == shard[known]
        start = np.flatnonzero(known)
        for lo in range(0, len(start), PROBES):
            probe = start[lo : lo + PROBES]
            node = self.roots[place[probe]]
            hits = []
            while len(probe):
                d = distance(code[probe], self.code[node])
                near = d <= radius
                hits.append((probe[near], node[near]))
                a = np.searchsorted(self.edges, node * 128 + np.maximum(d - radius, 0), "left")
                b = np.searchsorted(self.edges, node * 128 + np.minimum(d + radius, 127), "right")
                probe, node = np.repeat(probe, b - a), self.children[ranges(a, b - a)]
            yield tuple(np.concatenate(x) for x in zip(*hits))
