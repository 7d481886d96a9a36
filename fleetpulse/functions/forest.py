"""Isolation forest (Liu, Ting, Zhou: "Isolation Forest", ICDM 2008) on NumPy arrays.

All trees of a forest grow together, one level at a time. Nodes are numbered like a heap:
the children of node i are 2i+1 and 2i+2, so a tree is three flat arrays and needs no links.

Values are compared in single precision, and a feature whose values lie within 1e-7 counts as
constant. So the last bits of a feature, which depend on the order of a sum, do not matter.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np

EULER_GAMMA = 0.5772156649
CONSTANT_SPAN = 1e-7


class Forest(NamedTuple):
    feature: np.ndarray    # (trees, nodes) int16, -1 where the node is a leaf or unused
    threshold: np.ndarray  # (trees, nodes) float64, rows with x <= threshold go left
    size: np.ndarray       # (trees, nodes) int32, training rows that reached the node
    subsample: int


def expected_path(size: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of `size` rows."""
    m = np.asarray(size, dtype=np.float64)
    big = np.maximum(m, 3.0)
    value = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(m <= 1, 0.0, np.where(m == 2, 1.0, value))


@lru_cache(maxsize=4)
def _random(seed: int, trees: int, rows: int, psi: int, later: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows drawn for each tree, and the random numbers that follow; the same for all forests of one shape."""
    numbers = np.random.default_rng(seed).random(trees * rows + later)
    drawn = np.argpartition(numbers[: trees * rows].reshape(trees, rows), psi - 1, axis=1)[:, :psi].ravel()
    return drawn, numbers[trees * rows :]


def node_count(subsample: int) -> int:
    """Places of a tree that such a subsample grows, all levels filled."""
    return 2 ** (int(np.ceil(np.log2(max(subsample, 2)))) + 1) - 1


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def fit_forest(x: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    """Grow the forest; rows of x must already be in a fixed order."""
    x = x.astype(np.float32)
    rows, width = x.shape
    psi = min(subsample, rows)
    nodes = node_count(psi)
    depth = nodes.bit_length() - 1
    drawn, numbers = _random(seed, trees, rows, psi, trees * (2**depth - 1) * (width + 1))

    feature = np.full(trees * nodes, -1, dtype=np.int16)
    threshold = np.zeros(trees * nodes)
    size = np.zeros(trees * nodes, dtype=np.int32)

    # each column in ascending order, NaN last: row at a rank, its value, and the rank of a row
    order = np.argsort(x, axis=0, kind="stable").T
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(rows), order.shape), axis=1)
    values = np.take_along_axis(x.T, order, axis=1).ravel()
    columns, order, rank = x.T, order.ravel(), rank.ravel()

    def ascending(chosen: np.ndarray, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Place in order and values of the nodes' rows, in each node by its chosen column."""
        node = np.repeat(np.arange(len(sizes)) * rows, sizes)
        column = np.repeat(chosen * rows, sizes)
        key = (node + rank.take(column + held)).astype(np.int32 if len(sizes) * rows < 2**31 else np.int64)
        key.sort()
        return key - node + column

    # Rows of all trees, kept sorted by node, without those alone in a node; nodes count through all trees.
    ids = first = np.arange(trees) * nodes
    counts = np.full(trees, psi)
    drawn = drawn[: len(drawn) if psi > 1 else 0]
    for level in range(depth + 1):
        size[ids] = counts
        if level == depth:
            break
        # every node has its random numbers; those of a single row need none and are left out from here on
        several = np.flatnonzero(counts > 1)
        draw, at_cut = numbers[: len(ids) * width].reshape(-1, width)[several], numbers[len(ids) * width :][: len(ids)][several]
        numbers = numbers[len(ids) * (width + 1) :]
        ids, first, counts = ids[several], first[several], counts[several]
        if not len(ids):
            break
        starts = _runs(counts)
        # a random feature among those that still vary in the node: mostly the one with the largest draw
        chosen = draw.argmax(axis=1)
        place = ascending(chosen, counts, drawn)
        low = values[place[starts]].astype(np.float64)
        high = values[place[starts + counts - 1]].astype(np.float64)
        splits = high > low + CONSTANT_SPAN
        stuck = np.flatnonzero(~splits)
        if len(stuck):  # it does not vary, so the others are looked at
            sizes = counts[stuck]
            within = _runs(sizes)
            of = np.repeat(starts[stuck] - within, sizes) + np.arange(sizes.sum())
            held = columns.take(drawn[of], axis=1)
            lo, hi = (f.reduceat(held, within, axis=1).astype(np.float64) for f in (np.minimum, np.maximum))
            among = np.where(hi > lo + CONSTANT_SPAN, draw[stuck].T, -1.0)
            found = among.argmax(axis=0)
            pick = np.arange(len(stuck))
            chosen[stuck], splits[stuck] = found, among[found, pick] >= 0.0
            low[stuck], high[stuck] = lo[found, pick], hi[found, pick]
            place[of] = ascending(found, sizes, drawn[of])
        cut = low + at_cut * (high - low)
        cut = np.where(cut >= high, low, cut)  # keep both children non-empty after rounding
        feature[ids[splits]] = chosen[splits]
        threshold[ids[splits]] = cut[splits]
        if not splits.any():
            break

        # the rows of the left child come first already
        rights = np.add.reduceat(values.take(place) > np.repeat(cut, counts), starts, dtype=np.int64)[splits]
        lefts = counts[splits] - rights
        left = 2 * ids[splits] - first[splits] + 1
        ids = np.column_stack([left, left + 1]).ravel()
        children = np.column_stack([lefts, rights]).ravel()
        drawn = order.take(place[np.repeat(splits, counts)])[np.repeat(children > 1, children)]
        first = np.repeat(first[splits], 2)
        here = children > 0  # infinite readings may leave a side empty
        ids, counts, first = ids[here], children[here], first[here]
    shape = (trees, nodes)
    return Forest(feature.reshape(shape), threshold.reshape(shape), size.reshape(shape), psi)


def score_forest(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Anomaly score 2^(-mean path / expected path) in (0, 1]; larger is more anomalous."""
    trees, nodes = forest.feature.shape
    scale = float(expected_path(forest.subsample))
    if scale <= 0:
        return np.full(len(x), 0.5)
    # a leaf leads to itself, so all rows take the same number of steps
    feature, itself = forest.feature.ravel(), np.arange(trees * nodes)
    leaf, first = feature < 0, np.arange(trees) * nodes
    left = np.where(leaf, itself, 2 * itself - np.repeat(first, nodes) + 1)
    column = np.where(leaf, 0, feature.astype(np.int64) * len(x))
    threshold = np.where(leaf, np.inf, forest.threshold.ravel())
    values = x.T.astype(np.float32).astype(np.float64).ravel()
    row = np.arange(len(x))
    at = np.repeat(first[:, None], len(x), axis=1)  # node of each row in each tree, counted through all trees
    after, cell, value, cut = np.empty_like(at), np.empty_like(at), np.empty(at.shape), np.empty(at.shape)
    depth = np.floor(np.log2(np.arange(nodes) + 1))
    for _ in range(int(depth[-1])):
        column.take(at, out=cell, mode="clip")  # no position is out of range; so take needs no copy
        cell += row
        values.take(cell, out=value, mode="clip")
        threshold.take(at, out=cut, mode="clip")
        left.take(at, out=after, mode="clip")
        after += value > cut
        at, after = after, at
    rest = expected_path(np.arange(int(forest.size.max()) + 1)).take(forest.size)
    path = np.ascontiguousarray((depth + rest).take(at).T)
    return np.exp2(-path.mean(axis=1) / scale)


def _leaves(splits: np.ndarray) -> np.ndarray:
    """Where trees end: the roots and children of splits that are no splits themselves."""
    held = np.ones_like(splits)
    held[:, 1:] = np.repeat(splits[:, : splits.shape[1] // 2], 2, axis=1)
    return held & ~splits


def _narrow(whole: np.ndarray) -> bytes:
    return whole.astype(np.min_scalar_type(whole.max(initial=0))).tobytes()


def _widened(packed: bytes, count: int) -> np.ndarray:
    return np.frombuffer(packed, f"u{max(1, len(packed) // max(1, count))}")


def pack_forest(forest: Forest) -> dict[str, bytes]:
    """The forest without its unused places: a bit a place for splits, then their features and cuts, and the leaves' sizes."""
    splits = forest.feature >= 0
    return {
        "splits": np.packbits(splits).tobytes(),
        "feature": _narrow(forest.feature[splits]),
        "threshold": forest.threshold[splits].tobytes(),
        "size": _narrow(forest.size[_leaves(splits)]),
    }


def unpack_forest(packed: dict[str, bytes], trees: int, subsample: int) -> Forest:
    """What `pack_forest` was given, bit for bit; a split holds the rows of its two children."""
    nodes = node_count(subsample)
    shape = (trees, nodes)
    splits = np.unpackbits(np.frombuffer(packed["splits"], np.uint8), count=trees * nodes).astype(bool).reshape(shape)
    leaves = _leaves(splits)
    feature, threshold, size = np.full(shape, -1, np.int16), np.zeros(shape), np.zeros(shape, np.int32)
    feature[splits] = _widened(packed["feature"], np.count_nonzero(splits))
    threshold[splits] = np.frombuffer(packed["threshold"])
    size[leaves] = _widened(packed["size"], np.count_nonzero(leaves))
    for level in reversed(range(nodes.bit_length() - 1)):
        first, below = 2**level - 1, 2 ** (level + 1) - 1
        children = size[:, below : 2 * below + 1].reshape(trees, -1, 2).sum(axis=2)
        size[:, first:below] += children * splits[:, first:below]
    return Forest(feature, threshold, size, subsample)
