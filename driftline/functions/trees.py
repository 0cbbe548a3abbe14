"""Classification trees grown in memory, in numpy, by the rules of Spark ML's forests.

Values fall in bins between cut points; a node tries some of the features, takes the
split of the largest Gini gain and is a leaf at the depth limit, when its rows are of one
class, or when no split gains. What a tree draws (the weights of its rows, the
features of its nodes) comes from hashes of the row, the node, the tree's number and the
seed. So tree 7 is the same tree in a forest of 10 as in one of 100, and a tree of depth 5
is the upper part of the one of depth 20.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import factorial

import numpy as np

#: Row and feature pairs that are swept at once; each takes some 150 bytes.
PAIRS = 1 << 18
#: Gains up to this are rounding.
NO_GAIN = 1e-12

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: How often a row is drawn when as many rows are drawn as there are: Poisson with mean 1.
_DRAWN = np.cumsum([np.exp(-1.0) / factorial(k) for k in range(20)])


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _stream(seed: int, tree: int, use: int) -> np.ndarray:
    """One number for each use a tree makes of its seed; an array, since a single number would warn when it overflows."""
    return mix(mix(np.array([(seed + tree * int(_STEP)) % 2**64], np.uint64)) + np.uint64(use))


def drawn(ids: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    uniform = (mix(ids + _stream(seed, tree, 1)) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_DRAWN, uniform, side="right")


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Between all distinct values, or if they are too many, between ``bins`` about equal parts of the rows."""
    distinct, counts = np.unique(values, return_counts=True)
    between = (distinct[:-1] + distinct[1:]) / 2.0
    if len(between) < bins:
        return between
    stride = len(values) / bins
    running = np.cumsum(counts)
    # A cut goes before value i once the rows without it are nearer to the target than those with it.
    nearer = running[:-1] + running[1:]
    cuts, at, target = [], 0, stride
    while (at := max(at, int(np.searchsorted(nearer, 2 * target, side="right")))) < len(nearer):
        cuts.append(at)
        at, target = at + 1, target + stride
    return between[cuts]


def binned(matrix: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The bins of all values, a column for each feature; bin b ends with cut b."""
    out = np.empty(matrix.shape, np.uint8)
    for column, points in enumerate(cuts):
        out[:, column] = np.searchsorted(points, matrix[:, column], side="left")
    return out


@dataclass
class Tree:
    """Nodes level by level; the right child comes after the left one, and a leaf has no (-1) feature, bin and child."""

    feature: np.ndarray
    bin: np.ndarray  # rows up to this bin go left
    left: np.ndarray
    depth: np.ndarray
    gain: np.ndarray
    counts: np.ndarray  # rows of each class

    def leaves(self, depth: int) -> np.ndarray:
        """Where the tree of this depth ends; two leaves that say the same are one."""
        leaf = (self.left < 0) | (self.depth >= depth)
        says = self.counts.argmax(1)
        for level in range(min(depth, int(self.depth[-1])) - 1, -1, -1):
            # Levels stand one after the other.
            at = np.arange(*np.searchsorted(self.depth, [level, level + 1]))
            at = at[~leaf[at]]
            left = self.left[at]
            leaf[at] = leaf[left] & leaf[left + 1] & (says[left] == says[left + 1])
        return leaf

    def descend(self, bins: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(bins), np.int64)
        going = np.flatnonzero(~leaf[at])
        while len(going):
            here = at[going]
            at[going] = self.left[here] + (bins[going, self.feature[here]] > self.bin[here])
            going = going[~leaf[at[going]]]
        return at


def _tries(nodes: np.ndarray, features: int, tried: int) -> np.ndarray:
    """The features that each node tries."""
    tries = np.empty((len(nodes), min(tried, features)), np.int64)
    step = max(1, PAIRS // features)
    for start in range(0, len(nodes), step):
        some = slice(start, start + step)
        draw = mix(nodes[some, None] + np.arange(1, features + 1, dtype=np.uint64) * _STEP)
        tries[some] = np.sort(np.argpartition(draw, tries.shape[1] - 1, axis=1)[:, : tries.shape[1]], axis=1)
    return tries


def _running(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Sums at ``ends`` since the start of the group that each end is in."""
    sums = np.cumsum(values)
    return sums[ends] - (sums - values)[starts][group]


def _best_splits(
    bins: np.ndarray, label: np.ndarray, weight: np.ndarray, node: np.ndarray, counts: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, column, bin) of each node's best split; ``bins`` has a column for each feature that the node tries.

    The rows of a node and column are sorted by bin and swept once: a row of weight w
    changes the left side's sum of squared class counts by 2cw + w^2, where c is its class's count so far.
    """
    rows, columns = bins.shape
    nodes, classes = counts.shape
    pairs = rows * columns
    shift = max(1, (pairs - 1).bit_length())
    mask, order = (1 << shift) - 1, np.arange(pairs)
    key = (node[:, None] * columns + np.arange(columns)) * width + bins
    key = (key.ravel() << shift) | order
    key.sort()
    row, key = (key & mask) // columns, key >> shift
    group = key // width
    y, w = label[row], weight[row]
    by_class = ((group * classes + y) << shift) | order
    by_class.sort()
    place, by_class = by_class & mask, by_class >> shift
    before = np.cumsum(w[place]) - w[place]
    first = np.flatnonzero(np.r_[True, by_class[1:] != by_class[:-1]])
    left = np.empty(pairs, np.int64)
    left[place] = before - np.repeat(before[first], np.diff(np.r_[first, pairs]))
    right = counts[node[row], y] - left
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
    group, key = group[ends], key[ends]
    of = group // columns
    total, squares = counts.sum(1), (counts * counts).sum(1)
    n_left = _running(w, starts, ends, group)
    n_right = total[of] - n_left
    sq_left = _running(2 * left * w + w * w, starts, ends, group)
    sq_right = squares[of] + _running(w * w - 2 * right * w, starts, ends, group)
    inside = n_right > 0
    score = np.where(inside, sq_left / n_left + sq_right / np.maximum(n_right, 1), -np.inf)
    gain = (score - squares[of] / total[of]) / total[of]
    # The first of the best, as columns and bins go.
    begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    best = np.maximum.reduceat(gain, begins)
    hits = np.flatnonzero(gain == best[of])
    hits = hits[np.r_[True, of[hits][1:] != of[hits][:-1]]]
    return best, group[hits] % columns, key[hits] % width


def grow(
    bins: np.ndarray,
    label: np.ndarray,
    weight: np.ndarray,
    classes: int,
    depth: int,
    tried: int,
    seed: int,
    tree: int,
    pairs: int = PAIRS,
) -> Tree:
    """A tree on the rows of weight over 0; a node tries ``tried`` of the features."""
    features = bins.shape[1]
    width = int(bins.max(initial=0)) + 1
    stream = _stream(seed, tree, 2)
    row = np.flatnonzero(weight)
    y, w = label[row].astype(np.int64), weight[row].astype(np.int64)
    node = np.zeros(len(row), np.int64)  # of each row, among those that may be split
    counts = np.bincount(y, w, classes).astype(np.int64)[None, :]
    names = np.ones(1, np.uint64)  # the root is 1, the children of node i are 2i and 2i + 1
    open_ = counts.max(1) < counts.sum(1)
    levels = []
    for level in range(depth + 1):
        size = len(counts)
        feature, cut, left = (np.full(size, -1, np.int64) for _ in range(3))
        gain = np.zeros(size)
        levels.append((feature, cut, left, np.full(size, level), gain, counts))
        at = np.flatnonzero(open_)
        if level == depth or not len(at):
            break
        # Rows of leaves are done.
        place = np.full(size, -1)
        place[at] = np.arange(len(at))
        node = place[node]
        row, y, w, node = (x[node >= 0] for x in (row, y, w, node))
        tries = _tries(mix(names[at] + stream), features, tried)
        best, chosen, ends = np.full(len(at), -np.inf), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        step = max(1, pairs // len(row))
        for start in range(0, tries.shape[1], step):
            part = tries[:, start : start + step]
            found, column, end = _best_splits(bins[row[:, None], part[node]], y, w, node, counts[at], width)
            better = found > best
            best[better], ends[better] = found[better], end[better]
            chosen[better] = part[np.arange(len(at)), column][better]
        good = best > NO_GAIN
        split = at[good]
        feature[split], cut[split], gain[split] = chosen[good], ends[good], best[good]
        start = sum(len(x[0]) for x in levels)
        left[split] = start + 2 * np.arange(len(split))
        kept = good[node]
        row, y, w, node = (x[kept] for x in (row, y, w, node))
        right = bins[row, chosen[node]] > ends[node]
        node = 2 * (np.cumsum(good) - 1)[node] + right
        size = 2 * len(split)
        counts = np.bincount(node * classes + y, w, size * classes).reshape(size, classes).astype(np.int64)
        names = np.repeat(names[split] * np.uint64(2), 2)
        names[1::2] += np.uint64(1)
        open_ = counts.max(1) < counts.sum(1)
    return Tree(*(np.concatenate(x) for x in zip(*levels)))
