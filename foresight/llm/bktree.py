"""BK-tree over 64-bit fingerprints as flat arrays, built and searched level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

QUERY_BLOCK = 256


class BKTree:
    """The first point is the root; a node's children are keyed by their Hamming distance to it.

    ``edge[first[i]:first[i + 1]]`` are the distances of node ``i``'s children and ``child`` at the
    same places the children. Equal points hang below each other at distance 0.
    """

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        n = len(points)
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        left = np.arange(1, n)
        at = np.zeros(max(0, n - 1), dtype=np.int64)
        while len(left):
            distance = np.bitwise_count(points[left] ^ points[at]).astype(np.int64)
            slot = at * 65 + distance
            order = np.argsort(slot, kind="stable")
            left, at, distance, slot = left[order], at[order], distance[order], slot[order]
            first = np.ones(len(left), dtype=bool)
            first[1:] = slot[1:] != slot[:-1]
            parent[left[first]], edge[left[first]] = at[first], distance[first]
            owner = left[first][np.cumsum(first) - 1]
            left, at = left[~first], owner[~first]
        self.child = np.argsort(parent, kind="stable")[1:] if n else np.zeros(0, np.int64)
        self.edge = edge[self.child]
        self.first = np.searchsorted(parent[self.child], np.arange(n + 1))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) index pairs within ``radius``, following only edges that can lead to one."""
        for start in range(0, len(queries), QUERY_BLOCK):
            block = queries[start : start + QUERY_BLOCK]
            who, node = np.arange(len(block)), np.zeros(len(block), dtype=np.int64)
            hits_who, hits_node = [], []
            while len(who):
                distance = np.bitwise_count(block[who] ^ self.points[node]).astype(np.int64)
                near = distance <= radius
                hits_who.append(who[near])
                hits_node.append(node[near])
                fan = self.first[node + 1] - self.first[node]
                source = np.repeat(np.arange(len(who)), fan)
                place = np.arange(len(source)) - np.repeat(np.cumsum(fan) - fan, fan) + self.first[node][source]
                open_ = np.abs(self.edge[place] - distance[source]) <= radius
                who, node = who[source[open_]], self.child[place[open_]]
            yield start + np.concatenate(hits_who), np.concatenate(hits_node)
