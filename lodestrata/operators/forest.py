"""Random forests: trees bounded by leaves, grown best leaf first over distributed histograms, and trees of any number of leaves.

Features are cut into bins at quantiles. A round goes over the rows once for a whole group of trees: each row walks down every
tree and is counted, by its class, in the bins of every feature of the leaves made last. Only left children are counted, a
right one is what its parent has besides. The driver then splits the best leaves of every tree. What comes to it a round is
trees of the group x leaves split x features x bins x classes, whatever the number of rows.

Where the number of leaves is not bounded every leaf that can be split will be, in any order, so the driver keeps no histogram: it
splits all leaves of more than LOCAL rows level by level, CELLS numbers a pass at most, and the rows of each smaller leaf (a byte
or two a feature) are brought together once and its subtree is finished in a task. Only nodes come back, so the driver holds the model.

A row's weight in a tree is a Poisson draw from a hash of its key, so it depends on no partition, and counts are whole numbers:
the same table gives the same forest. Balanced weights are applied to counts of classes.
Null and NaN features count as lowest; rows without a label or weight teach nothing; a table without labels gives a forest
without classes, whose predictions are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.operators.passes import matrix, scored, totals

GROUP = 50
MAX_CLASSES = 100
#: Leaves of up to so many rows of a tree are finished in one task.
LOCAL = 1 << 16
#: Numbers of histograms at a time.
CELLS = 1 << 20


class Tree:
    """Nodes in lists: the feature a node asks for (-1: a leaf), the last bin that goes left, the left child (the right one
    is next to it), the depth, and the classes counted in it."""

    def __init__(self, counts: np.ndarray):
        self.feature, self.cut, self.left, self.depth, self.counts = [-1], [0], [0], [0], [counts]

    def split(self, node: int, feature: int, cut: int, counts: np.ndarray) -> int:
        """Two new leaves; counts are those of the left one, which is returned."""
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for c in (counts, self.counts[node] - counts):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.depth.append(self.depth[node] + 1)
            self.counts.append(c)
        return self.left[node]

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to."""
        feature, cut, left = np.array(self.feature), np.array(self.cut), np.array(self.left)
        node, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
        while (inner := feature[node] >= 0).any():
            goes = bins[rows, np.maximum(feature[node], 0)] > cut[node]
            node = np.where(inner, left[node] + goes, node)
        return node


def mixed(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Keys whose bits are mixed with those of the tree."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64) + np.uint64(seed % 2**32) * np.uint64(0xD1342543DE82EF95)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return x ^ (x >> np.uint64(31))


def poisson(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A Poisson draw of mean 1 for each key."""
    x = mixed(keys, tree, seed)
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
    return np.searchsorted(steps, (x >> np.uint64(11)).astype(np.float64) / 2**53, side="right")


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    bins = np.column_stack([np.searchsorted(e, np.nan_to_num(x[:, k], nan=-np.inf, posinf=np.inf, neginf=-np.inf), side="left") for k, e in enumerate(edges)])
    return bins.astype(np.int64)


def gains(hist: np.ndarray, parent: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By feature and cut, how much a split lowers the weighted Gini impurity; hist counts classes by feature and bin, or by leaf
    and bin (parent: classes, or leaf and classes). Cuts that leave a side empty give -1."""
    left = hist.cumsum(axis=-2)[..., :-1, :] * weights
    whole = (parent * weights)[..., None, :]
    right = whole - left
    a, b, all_ = left.sum(axis=-1), right.sum(axis=-1), whole.sum(axis=-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left**2).sum(axis=-1) / a + (right**2).sum(axis=-1) / b - (whole**2).sum(axis=-1) / all_
    return np.where((a > 1e-12) & (b > all_ * 1e-12), gain, -1.0)


def _sides(paths: np.ndarray) -> np.ndarray:
    """Paths (64 bits) of the left and right children of each."""
    return np.column_stack([mixed(paths, side, 1) for side in (0, 1)]).ravel()


def _drawn(paths: np.ndarray, tree: int, features: int, tried: int | None, seed: int) -> np.ndarray:
    """By leaf and feature, whether it may split the leaf: a draw from the leaf's path, whatever the order of splits."""
    if tried is None or tried >= features:
        return np.ones((len(paths), features), dtype=bool)
    of = np.column_stack([mixed(mixed(paths, f, seed), tree, seed) for f in range(features)])
    return of.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable") < tried


class Forest:
    def __init__(self, features: list[str], edges: list[np.ndarray], classes: list, weights: np.ndarray, trees: list[Tree]):
        self.features, self.edges, self.classes, self.weights, self.trees = features, edges, classes, weights, trees

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean over trees of the weighted shares of classes in a row's leaf."""
        out, bins = np.zeros((len(x), len(self.classes))), _binned(x, self.edges)
        for tree in self.trees:
            share = np.array(tree.counts) * self.weights
            out += (share / share.sum(axis=1, keepdims=True))[tree.leaves(bins)]
        return out / len(self.trees)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with probability (of the classes in order) and prediction (ties to the first)."""
        if not self.classes:
            return df.withColumns({"probability": F.lit(None).cast("array<double>"), "prediction": F.lit(None).cast("double")})

        def score(x: np.ndarray) -> dict[str, np.ndarray]:
            p = self.probabilities(x)
            return {"probability": p, "prediction": np.array(self.classes, dtype=np.float64)[p.argmax(axis=1)]}

        return scored(df, self.features, score, {"probability": T.ArrayType(T.DoubleType()), "prediction": T.DoubleType()})


def fit(
    df: DataFrame, features: list[str], label: str, key: str, trees: int = 100, leaves: int | None = 30, depth: int | None = None, balanced: bool = False,
    tried: int | None = None, bootstrap: bool = True, bins: int = 32, splits: int = 1, seed: int = 42,
) -> Forest:
    """A forest for a numeric label.

    leaves and depth bound a tree. splits: so many leaves of a tree are split in a round; 1 is best-first in the strict sense, a
    larger number takes fewer passes and keeps to the same bounds; without a bound of leaves all are split anyway. tried: so many features, drawn for each leaf, may split it (all
    unless given). balanced: a class weighs as the inverse of its share of rows."""
    numbers = [F.col(c).cast("double").alias(c) for c in features]
    known = df.where(F.col(label).isNotNull()).select(*numbers, F.col(label).cast("double").alias("_y"), F.shiftrightunsigned(F.xxhash64(key), 11).alias("_key")).persist()  # numbers alone; 53 bits of the key, exact as a double
    try:
        return _fitted(known, features, trees, leaves, depth, balanced, tried, bootstrap, bins, splits, seed)
    finally:
        known.unpersist()


def _fitted(known: DataFrame, features: list[str], trees: int, leaves: int | None, depth: int | None, balanced: bool, tried: int | None, bootstrap: bool, bins: int, splits: int, seed: int) -> Forest:
    counts = {r[0]: r[1] for r in known.groupBy("_y").agg(F.count("*").alias("n")).orderBy("_y").limit(MAX_CLASSES + 1).collect()}
    classes = list(counts)
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    n = sum(counts.values())
    weights = np.array([n / (len(classes) * c) if balanced else 1.0 for c in counts.values()])
    shares = [k / bins for k in range(1, bins)]
    usable = lambda c: F.when(~F.isnan(c), F.col(c))
    found = known.agg(*[F.percentile_approx(usable(c), shares, 10_000).alias(f"e{i}") for i, c in enumerate(features)]).first()
    edges = [np.unique(np.array(found[i] or [], dtype=np.float64)) for i in range(len(features))]
    forest = Forest(features, edges, classes, weights, [])
    if classes and leaves is None:
        forest.trees = _deep(known, forest, n, trees, depth, tried, bootstrap, bins, seed)
    elif classes:
        for first in range(0, trees, GROUP):
            forest.trees += _grown(known, forest, range(first, min(trees, first + GROUP)), leaves, depth, tried, bootstrap, bins, splits, seed)
    return forest


def _histograms(rows: DataFrame, forest: Forest, trees: list[Tree], numbers: range, slots: list[tuple[int, int]], bootstrap: bool, bins: int, seed: int) -> np.ndarray:
    """Histograms of the leaves (place of the tree, node) given; without trees, of their roots."""
    features, edges, classes = forest.features, forest.edges, np.array(forest.classes)
    shape, cells = (len(features), bins, len(classes)), bins * len(classes)
    mine: dict[int, list[tuple[int, int]]] = {}
    for s, (t, node) in enumerate(slots):
        mine.setdefault(t, []).append((node, s))

    def measure(x: np.ndarray) -> np.ndarray:
        b, y, keys = _binned(x[:, : len(features)], edges), np.searchsorted(classes, x[:, -2]), x[:, -1].astype(np.uint64)
        out = np.zeros((len(slots), len(features), cells))
        for t, wanted in mine.items():
            w = poisson(keys, numbers[t], seed) if bootstrap else np.ones(len(x), dtype=np.int64)
            node = trees[t].leaves(b) if trees else np.zeros(len(x), dtype=np.int64)
            place = np.full(max(int(node.max()), max(k for k, _ in wanted)) + 1, -1)
            place[[k for k, _ in wanted]] = np.arange(len(wanted))
            here = np.flatnonzero((place[node] >= 0) & (w > 0))
            at, own = [s for _, s in wanted], place[node[here]] * cells + y[here]
            for f in range(len(features)):
                out[at, f] += np.bincount(own + b[here, f] * len(classes), w[here], len(wanted) * cells).reshape(-1, cells)
        return out.ravel()

    return totals(rows, [*features, "_y", "_key"], measure, len(slots) * math.prod(shape)).reshape(len(slots), *shape)


def subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, path: int, tree: int, depth: int | None, tried: int | None, bins: int, seed: int) -> tuple[np.ndarray, ...]:
    """feature, cut, left, depth and counts of the nodes of a tree over rows of bins x, classes y and whole weights w, grown level by
    level until no split gains."""
    k, features = len(weights), x.shape[1]
    counts = [np.bincount(y, w, k)[None, :]]
    out = [np.full(1, -1), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)]
    first, level, paths, at = 0, 0, np.array([path], dtype=np.uint64), np.zeros(len(x), dtype=np.int64)  # rows stand in order of leaf
    while depth is None or level < depth:
        n = len(paths)
        gain, feature, cut = np.zeros(n), np.full(n, -1), np.zeros(n, np.int64)
        some = (counts[-1] > 0).sum(axis=1) > 1
        may = _drawn(paths, tree, features, tried, seed) & some[:, None]
        step = max(1, CELLS // (bins * k))
        for lo in range(0, n, step):
            hi = min(n, lo + step)
            r = slice(*np.searchsorted(at, [lo, hi]))
            for f in range(features):
                own = np.flatnonzero(may[lo:hi, f])
                if not len(own):
                    continue
                place = np.full(hi - lo, -1)
                place[own] = np.arange(len(own))
                in_ = place[at[r] - lo]
                rows = np.flatnonzero(in_ >= 0)
                hist = np.bincount((in_[rows] * bins + x[r][rows, f]) * k + y[r][rows], w[r][rows], len(own) * bins * k).reshape(-1, bins, k)
                g = gains(hist, counts[-1][lo + own], weights)
                c = g.argmax(axis=1)
                g = g[np.arange(len(own)), c]
                won = g > np.maximum(gain[lo + own], 1e-12)
                gain[lo + own[won]], feature[lo + own[won]], cut[lo + own[won]] = g[won], f, c[won]
        split = np.flatnonzero(feature >= 0)
        if not len(split):
            break
        left = np.zeros(n, np.int64)
        left[split] = first + n + 2 * np.arange(len(split))
        out[0][first:], out[1][first:], out[2][first:] = feature, cut, left
        place = np.full(n, -1)
        place[split] = np.arange(len(split))
        rows = np.flatnonzero(place[at] >= 0)
        x, y, w, at = x[rows], y[rows], w[rows], at[rows]
        at = 2 * place[at] + (x[np.arange(len(x)), feature[at]] > cut[at])
        order = np.argsort(at, kind="stable")
        x, y, w, at = x[order], y[order], w[order], at[order]
        first, level, paths = first + n, level + 1, _sides(paths[split])
        counts.append(np.bincount(at * k + y, w, len(paths) * k).reshape(-1, k))
        new = len(paths)
        out = [np.concatenate([o, np.full(new, v)]) for o, v in zip(out, (-1, 0, 0, level), strict=True)]
    return *out, np.concatenate(counts)


_PACKED = "tree int, leaf int, blob binary"
_NODES = "tree int, leaf int, feature binary, cut binary, left binary, depth binary, counts binary"


def _deep(rows: DataFrame, forest: Forest, n: int, trees: int, depth: int | None, tried: int | None, bootstrap: bool, bins: int, seed: int) -> list[Tree]:
    """Trees of any number of leaves."""
    features, edges, classes, weights = forest.features, forest.edges, np.array(forest.classes), forest.weights
    wide, local = len(features), LOCAL
    grown = [Tree(np.zeros(len(classes))) for _ in range(trees)]
    paths = [[np.uint64(1)] for _ in grown]
    open_ = [(i, 0) for i in range(trees)] if n > local else []
    most = max(1, CELLS // (wide * bins * len(classes)))
    while open_:
        then = []
        for start in range(0, len(open_), most):
            part = open_[start : start + most]
            for (i, node), h in zip(part, _histograms(rows, forest, grown, range(trees), part, bootstrap, bins, seed), strict=True):
                tree = grown[i]
                tree.counts[node] = h[0].sum(axis=0)
                gain = gains(h, tree.counts[node], weights)
                gain[~_drawn(np.array([paths[i][node]]), i, wide, tried, seed)[0]] = -1
                f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, cut] > 1e-12 and depth != 0:
                    child = tree.split(node, int(f), int(cut), h[f, : cut + 1].sum(axis=0))
                    paths[i] += list(_sides(np.array([paths[i][node]])))
                    then += [(i, c) for c in (child, child + 1) if tree.counts[c].sum() > local and (tree.counts[c] > 0).sum() > 1 and (depth is None or tree.depth[c] < depth)]
        open_ = then
    bound = [np.array(t.depth) for t in grown]
    todo = [(np.array(t.feature) < 0) & ((np.array(t.counts).sum(axis=1) <= local) & ((np.array(t.counts) > 0).sum(axis=1) != 1)) for t in grown]
    if depth is not None:
        todo = [m & (d < depth) | (d == 0) & m for m, d in zip(todo, bound, strict=True)]
    kind = np.dtype(np.uint8 if bins <= 256 else np.uint16)
    names = [*features, "_y", "_key"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch)
            b, y, keys = _binned(x[:, :wide], edges), np.searchsorted(classes, x[:, -2]), x[:, -1].astype(np.uint64)
            for i, tree in enumerate(grown):
                w = poisson(keys, i, seed) if bootstrap else np.ones(len(x), dtype=np.int64)
                leaf = tree.leaves(b)
                at = np.flatnonzero((w > 0) & todo[i][leaf])
                at = at[np.argsort(leaf[at], kind="stable")]
                own = np.column_stack([b[at], y[at], w[at]]).astype(kind)
                edge = np.flatnonzero(np.r_[True, np.diff(leaf[at]) != 0, True]) if len(at) else np.zeros(1, np.int64)
                if len(edge) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(edge) - 1, i), pa.int32()), pa.array(leaf[at[edge[:-1]]], pa.int32()), pa.array([own[lo:hi].tobytes() for lo, hi in zip(edge, edge[1:], strict=False)], pa.binary())], names=["tree", "leaf", "blob"])

    def finished(key: tuple, table: pa.Table) -> pa.Table:
        i, leaf = (v.as_py() for v in key)
        own = np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table.column("blob")]).reshape(-1, wide + 2).astype(np.int64)
        found = subtree(own[:, :wide], own[:, wide], own[:, wide + 1], weights, paths[i][leaf], i, None if depth is None else depth - int(bound[i][leaf]), tried, bins, seed)
        kinds = (np.int16, np.int16, np.int32, np.int32, np.int32)
        return pa.table([pa.array([i], pa.int32()), pa.array([leaf], pa.int32()), *[pa.array([f.astype(k).tobytes()], pa.binary()) for f, k in zip(found, kinds, strict=True)]], names=["tree", "leaf", "feature", "cut", "left", "depth", "counts"])

    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sent = rows.select([F.col(f"`{c}`").cast("double").alias(c) for c in names]).mapInArrow(packed, _PACKED).repartition(parts, "tree", "leaf")
    return _grafted(grown, sent.groupBy("tree", "leaf").applyInArrow(finished, _NODES).collect(), len(classes))


def _grafted(grown: list[Tree], found: list, k: int) -> list[Tree]:
    """The trees as arrays, with their leaves' subtrees."""
    own: list[list] = [[] for _ in grown]
    for r in found:
        own[r.tree].append(r)
    for tree, rows in zip(grown, own, strict=True):
        columns = [[np.array(v, dtype=d)] for v, d in ((tree.feature, np.int16), (tree.cut, np.int16), (tree.left, np.int32), (tree.depth, np.int32))]
        counts, size = [np.array(tree.counts, dtype=np.int32).reshape(-1, k)], len(tree.feature)
        for r in sorted(rows, key=lambda r: r.leaf):
            feature, cut = (np.frombuffer(b, np.int16) for b in (r.feature, r.cut))
            left, depth, c = (np.frombuffer(b, np.int32) for b in (r.left, r.depth, r.counts))
            left = np.where(feature >= 0, left + size - 1, 0)  # the first node takes the leaf's place
            depth = depth + columns[3][0][r.leaf]
            for col, v in zip(columns, (feature, cut, left, depth), strict=True):
                col[0][r.leaf] = v[0]
                col.append(v[1:])
            counts[0][r.leaf] = c[:k]
            counts.append(c.reshape(-1, k)[1:])
            size += len(feature) - 1
        tree.feature, tree.cut, tree.left, tree.depth = (np.concatenate(c) for c in columns)
        tree.counts = np.concatenate(counts)
    return grown


def _grown(rows: DataFrame, forest: Forest, numbers: range, leaves: int, depth: int | None, tried: int | None, bootstrap: bool, bins: int, splits: int, seed: int) -> list[Tree]:
    features = forest.features
    trees: list[Tree] = []
    hists: dict[tuple[int, int], np.ndarray] = {}  # of open leaves

    counted = lambda slots: _histograms(rows, forest, list(trees), numbers, slots, bootstrap, bins, seed)

    first = counted([(i, 0) for i in range(len(numbers))])
    for i in range(len(numbers)):
        trees.append(Tree(first[i][0].sum(axis=0)))
        hists[i, 0] = first[i]

    def best(i: int, node: int) -> tuple[float, int, int]:
        """(gain, feature, cut) of the best split of a leaf; gain 0 if there is none."""
        tree = trees[i]
        if depth is not None and tree.depth[node] >= depth or (tree.counts[node] > 0).sum() < 2:
            return 0.0, 0, 0
        gain = gains(hists[i, node], tree.counts[node], forest.weights)
        if tried is not None and tried < len(features):
            out = np.ones(len(features), dtype=bool)
            out[np.random.default_rng([seed, numbers[i], node]).choice(len(features), tried, replace=False)] = False
            gain[out] = -1
        f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        return max(float(gain[f, cut]), 0.0), int(f), int(cut)

    open_leaves = {(i, 0): best(i, 0) for i in range(len(numbers))}
    while True:
        made: list[tuple[int, int, int]] = []  # place of the tree, split node, left child
        for i, tree in enumerate(trees):
            room = min(splits, leaves - (len(tree.feature) + 1) // 2)
            mine = sorted((-g, node, f, cut) for (t, node), (g, f, cut) in open_leaves.items() if t == i and g > 1e-12)
            for _, node, f, cut in mine[: max(room, 0)]:
                made.append((i, node, tree.split(node, f, cut, hists[i, node][f, : cut + 1].sum(axis=0))))
                del open_leaves[i, node]
        if not made:
            return trees
        left = counted([(i, child) for i, _, child in made])
        for h, (i, node, child) in zip(left, made, strict=True):
            hists[i, child], hists[i, child + 1] = h.copy(), hists.pop((i, node)) - h  # a view would hold the whole round's
            for c in (child, child + 1):
                open_leaves[i, c] = best(i, c)
