"""Ward tree and cuts of a few points, built one merge after the other: what tests compare with."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Merges in order of height. Nodes 0…m-1 are leaves, node m+i is merge i."""

    left: np.ndarray
    right: np.ndarray
    height: np.ndarray
    size: np.ndarray
    leaves: int


def euclidean(points: np.ndarray) -> np.ndarray:
    squared = (points**2).sum(axis=1)
    gaps = squared[:, None] + squared[None, :] - 2 * points @ points.T
    np.fill_diagonal(gaps, 0.0)
    return np.sqrt(np.maximum(gaps, 0.0))


def ward_tree(dissimilarity: np.ndarray, sizes: np.ndarray | None = None) -> Tree:
    """Ward merges of the given (unsquared) dissimilarities.

    A point of size s stands for s coincident rows, so the tree above such
    points equals the tree over the rows. Merges follow the Lance–Williams
    update; nearest neighbours are chained until two points choose each other.
    """
    m = len(dissimilarity)
    weight = np.ones(m) if sizes is None else np.asarray(sizes, dtype=float).copy()
    gap = np.asarray(dissimilarity, dtype=float) * (
        2 * np.outer(weight, weight) / np.add.outer(weight, weight)
    )
    np.fill_diagonal(gap, np.inf)
    alive = np.ones(m, dtype=bool)
    found: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while len(found) < m - 1:
        if not chain:
            chain = [int(alive.argmax())]
        tip = chain[-1]
        near = int(gap[tip].argmin())
        if len(chain) > 1 and gap[tip, chain[-2]] <= gap[tip, near]:
            a, b = sorted((chain.pop(), chain.pop()))
            height = gap[a, b]
            total = weight[a] + weight[b]
            merged = (
                (weight[a] + weight) * gap[a] + (weight[b] + weight) * gap[b] - weight * height
            ) / (total + weight)
            merged[~alive] = np.inf
            merged[[a, b]] = np.inf
            gap[a], gap[:, a] = merged, merged
            gap[b], gap[:, b] = np.inf, np.inf
            weight[a], alive[b] = total, False
            found.append((height, a, b))
        else:
            chain.append(near)
    return _in_height_order(found, m, sizes)


def _in_height_order(
    found: list[tuple[float, int, int]], m: int, sizes: np.ndarray | None
) -> Tree:
    order = sorted(range(len(found)), key=lambda i: found[i][0])
    held = {i: 1.0 if sizes is None else float(sizes[i]) for i in range(m)}
    root = list(range(m))

    def node_of(leaf: int) -> int:
        while root[leaf] != leaf:
            leaf = root[leaf]
        return leaf

    name = {i: i for i in range(m)}
    left, right, height, size = [], [], [], []
    for step, i in enumerate(order):
        h, a, b = found[i]
        a, b = node_of(a), node_of(b)
        first, second = sorted((name[a], name[b]))
        left.append(first)
        right.append(second)
        height.append(h)
        held[m + step] = held[first] + held[second]
        size.append(held[m + step])
        root[b] = a
        name[a] = m + step
    return Tree(np.array(left), np.array(right), np.array(height), np.array(size), m)


def leaf_order(tree: Tree) -> list[int]:
    """Leaves from left to right; leaves before merges, earlier merges first."""
    pending, found = [tree.leaves + len(tree.height) - 1], []
    while pending:
        node = pending.pop()
        if node < tree.leaves:
            found.append(node)
        else:
            pending += [int(tree.right[node - tree.leaves]), int(tree.left[node - tree.leaves])]
    return found


def labels_at(tree: Tree, k: int) -> np.ndarray:
    """Labels 1…k of the leaves, numbered in order of first appearance."""
    if not 1 <= k <= tree.leaves:
        raise ValueError(f"k must be between 1 and {tree.leaves}")
    owner = list(range(tree.leaves + len(tree.height)))
    for step in range(tree.leaves - k):
        owner[tree.left[step]] = owner[tree.right[step]] = tree.leaves + step
    seen: dict[int, int] = {}
    labels = []
    for leaf in range(tree.leaves):
        node = leaf
        while owner[node] != node:
            node = owner[node]
        labels.append(seen.setdefault(node, len(seen) + 1))
    return np.array(labels)
