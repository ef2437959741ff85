"""Boosted regression trees grown from histograms.

A row is its features' bins (a byte's worth each, the last one for missing
values), a target and the score so far. For each round of a tree one job sums
gradients and counts by (node, feature, bin): tasks add up their own rows, one
aggregation adds the tasks. Of two siblings only the smaller is summed, the
other is the parent less it. Gradients are whole multiples of a power of two,
so sums are exact and the trees don't depend on the partitioning.

Leaves are split best-first. A round looks at all the leaves that the best-first
order may still reach, so a tree takes about as many jobs as it is deep. What
the driver holds is bounded by leaves x features x bins, not by rows.
"""

from __future__ import annotations

import heapq
import random
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ModelConfig

#: Bins of values of a feature, of equal width over its range (ranks of a date are uniform).
VALUES = 255
#: The bin of missing values.
MISSING = 255
#: Bits of a gradient below the targets' spread.
GRADIENT_BITS = 30
#: After so many trees the scores are written, so that no job evaluates more.
WRITTEN_TREES = 10


@dataclass(frozen=True)
class Split:
    """Bins up to `bin` go left, missing values as told; left: whole gradient and count."""

    feature: int
    bin: int
    missing_left: bool
    gain: float
    left: tuple[int, int]


@dataclass
class Tree:
    """Nodes in parallel lists; a leaf's feature is -1. Node 0 is the root."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, s: Split) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.missing_left[node] = s.feature, s.bin, s.missing_left
        at = len(self.feature)
        self.left[node], self.right[node] = at, at + 1
        for part, none in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, 0), (self.right, 0), (self.value, 0.0)):
            part += [none, none]
        return at, at + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        feature, cut, missing, left, right = (np.asarray(p) for p in (self.feature, self.bin, self.missing_left, self.left, self.right))
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            v = x[rows, feature[at]]
            node[rows] = np.where(np.where(v == MISSING, missing[at], v <= cut[at]), left[at], right[at])
        return node


def scores(trees: Sequence[Tree], x: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = start.astype(np.float64)
    for tree in trees:
        out += np.asarray(tree.value)[tree.leaves(x)]
    return out


@dataclass(frozen=True)
class Booster:
    columns: tuple[str, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    base: float
    trees: tuple[Tree, ...]

    def predict(self, df: DataFrame, name: str = "model_score") -> DataFrame:
        """df with the score; missing features go the way that their split learned."""
        base, trees = self.base, self.trees

        @F.pandas_udf("double")
        def of(bins):  # noqa: ANN001, ANN202
            import pandas as pd

            x = np.stack(bins.to_numpy()) if len(bins) else np.zeros((0, 1), np.int16)
            return pd.Series(scores(trees, x, np.full(len(x), base)))

        return df.withColumn(name, of(binned(self.columns, self.lows, self.highs)))


def binned(columns: Sequence[str], lows: Sequence[float], highs: Sequence[float]) -> Column:
    """The bins of a row: values beyond the range go to its ends; null and NaN are missing."""
    out = []
    for c, low, high in zip(columns, lows, highs, strict=True):
        x = F.col(c).cast("double")
        at = F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(VALUES)))
        out.append(F.when(x.isNull() | F.isnan(x), MISSING).otherwise(F.greatest(F.lit(0), F.least(F.lit(VALUES - 1), at))).cast("short"))
    return F.array(*out)


def bagged(keys: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether each row takes part in a tree, by a hash of its key alone."""
    if share >= 1:
        return np.ones(len(keys), bool)
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) ^ np.uint64(random.Random(f"{seed}:{tree}:rows").getrandbits(64))
        # The finaliser of SplitMix64.
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x.astype(np.float64) < share * 2.0**64


def sampled(features: int, tree: int, seed: int, share: float) -> list[int]:
    k = max(1, round(features * share))
    return sorted(random.Random(f"{seed}:{tree}:columns").sample(range(features), k))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    bins, key, target, score = batch.columns
    x = bins.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    return x, *(c.to_numpy(zero_copy_only=False) for c in (key, target, score))


def histograms(rows: DataFrame, done: Sequence[Tree], tree: Tree, wanted: Sequence[int], features: Sequence[int], number: int, scale: float, config: ModelConfig) -> DataFrame:
    """(node, feature, bin, g, n) of the wanted leaves of a growing tree: whole
    gradients of squared loss and counts of the rows that take part."""
    seed, share = config.random_state, config.subsample

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = VALUES + 1
        slot = np.full(len(tree.feature), -1)
        slot[list(wanted)] = range(len(wanted))
        g, n = (np.zeros((len(features), len(wanted) * size), np.int64) for _ in range(2))
        for batch in batches:
            x, key, target, score = _matrix(batch)
            at = slot[tree.leaves(x)]
            used = (at >= 0) & bagged(key, number, seed, share)
            x, at = x[used], at[used] * size
            gradient = np.rint((scores(done, x, score[used]) - target[used]) * scale)
            for i, f in enumerate(features):
                cell = at + x[:, f]
                g[i] += np.rint(np.bincount(cell, gradient, g.shape[1])).astype(np.int64)
                n[i] += np.bincount(cell, minlength=g.shape[1])
        i, cell = np.nonzero(n)
        parts = (np.asarray(wanted)[cell // size], np.asarray(features)[i], cell % size, g[i, cell], n[i, cell])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)) for p in parts], ["node", "feature", "bin", "g", "n"])

    found = rows.mapInArrow(sums, "node long, feature long, bin long, g long, n long")
    return found.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def best_splits(g: np.ndarray, n: np.ndarray, scale: float, config: ModelConfig) -> list[Split | None]:
    """Of each feature the split of the greatest gain from sums by (feature, bin);
    of equal gains the lowest bin, then missing values to the right."""
    missing = np.array([0, 1])
    left_g = np.cumsum(g[:, :VALUES], 1)[..., None] + g[:, VALUES, None, None] * missing
    left_n = np.cumsum(n[:, :VALUES], 1)[..., None] + n[:, VALUES, None, None] * missing
    all_g, all_n = g.sum(1)[:, None, None], n.sum(1)[:, None, None]

    def part(g: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(np.abs(g / scale) - config.reg_alpha, 0) ** 2 / np.maximum(n + config.reg_lambda, 1e-12)

    gain = part(left_g, left_n) + part(all_g - left_g, all_n - left_n) - part(all_g, all_n)
    enough = (left_n >= config.min_child_samples) & (all_n - left_n >= config.min_child_samples)
    gain = np.where(enough, gain, -np.inf).reshape(len(g), -1)
    out: list[Split | None] = []
    for i, at in enumerate(gain.argmax(1)):
        b, m = divmod(int(at), 2)
        out.append(Split(i, b, bool(m), float(gain[i, at]), (int(left_g[i, b, m]), int(left_n[i, b, m]))) if gain[i, at] > 0 else None)
    return out


class _Node:
    def __init__(self, sums: tuple[int, int], depth: int) -> None:
        self.sums, self.depth = sums, depth
        self.kids: tuple[int, int] | None = None
        self.split: Split | None = None
        self.g: np.ndarray | None = None
        self.n: np.ndarray | None = None


def _read(found: DataFrame, features: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    node, feature, b, g, n = (c.to_numpy() for c in found.select("node", "feature", "bin", "g", "n").toArrow().columns)
    out = {}
    for i in np.unique(node):
        at = node == i
        out[int(i)] = tuple(np.zeros((features, VALUES + 1), np.int64) for _ in range(2))
        for held, x in zip(out[int(i)], (g, n), strict=True):
            held[feature[at], b[at]] = x[at]
    return out


def grow(rows: DataFrame, done: Sequence[Tree], features: int, number: int, scale: float, config: ModelConfig) -> Tree | None:
    """The next tree, None if no split gains."""
    tree, used = Tree(), sampled(features, number, config.random_state, config.colsample_bytree)
    deepest = config.max_depth if config.max_depth > 0 else config.num_leaves
    budget = config.num_leaves - 1

    def sums(wanted: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return _read(histograms(rows, done, tree, wanted, used, number, scale, config), features)

    def settle(node: _Node, g: np.ndarray, n: np.ndarray) -> None:
        node.g, node.n = g, n
        if node.depth < deepest:
            # a feature that wasn't drawn has no rows, hence no split
            found = [s for s in best_splits(g, n, scale, config) if s]
            node.split = max(found, key=lambda s: (s.gain, -s.feature), default=None)

    first = sums([0]).get(0)
    if first is None:
        return None
    nodes = [_Node((int(first[0][used[0]].sum()), int(first[1][used[0]].sum())), 0)]
    settle(nodes[0], *first)
    if nodes[0].split is None:
        return None
    while True:
        heap, taken, unknown = [(-nodes[0].split.gain, 0)], [], []
        while heap and len(taken) < budget and not unknown:
            _, i = heapq.heappop(heap)
            taken.append(i)
            if nodes[i].kids is None and len(taken) < budget:
                # with it all leaves that the rest of the budget may reach
                unknown = [i, *(k for _, k in heapq.nsmallest(budget - len(taken), (x for x in heap if nodes[x[1]].kids is None)))]
            elif nodes[i].kids:
                for k in nodes[i].kids:
                    if nodes[k].split:
                        heapq.heappush(heap, (-nodes[k].split.gain, k))
        if not unknown:
            break
        smaller = {}
        for i in unknown:
            s, node = nodes[i].split, nodes[i]
            node.kids = tree.grow(i, s)
            nodes += [_Node(s.left, node.depth + 1), _Node((node.sums[0] - s.left[0], node.sums[1] - s.left[1]), node.depth + 1)]
            smaller[i] = min(node.kids, key=lambda k: nodes[k].sums[1])
        found = sums(list(smaller.values()))
        for i, k in smaller.items():
            other = sum(nodes[i].kids) - k
            settle(nodes[k], *found[k])
            settle(nodes[other], nodes[i].g - found[k][0], nodes[i].n - found[k][1])
            nodes[i].g = nodes[i].n = None

    out, at = Tree(), {0: 0}
    value = lambda s: -config.learning_rate * float(np.sign(s[0])) * max(abs(s[0] / scale) - config.reg_alpha, 0.0) / (s[1] + config.reg_lambda)
    for i in taken:
        s, (g, n) = nodes[i].split, nodes[i].sums
        pair = out.grow(at[i], s)
        at.update(zip(nodes[i].kids or (), pair, strict=False))
        out.value[pair[0]], out.value[pair[1]] = value(s.left), value((g - s.left[0], n - s.left[1]))
    return out


def _written(rows: DataFrame, trees: Sequence[Tree]) -> DataFrame:
    """rows with the trees in their scores, in the checkpoint folder that all executors share."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='panelwright-')}")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _, _, score = _matrix(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores(trees, x, score))], ["bins", "key", "target", "score"])

    return rows.mapInArrow(scored, "bins array<smallint>, key long, target double, score double").checkpoint()


def prepared(df: DataFrame, columns: Sequence[str], lows: Sequence[float], highs: Sequence[float], target: Column, key: Column) -> tuple[DataFrame, float, float]:
    """(rows to fit on, the mean of their target, what gradients are multiplied
    by). A column whose bounds are equal must have been left out."""
    rows = df.select(binned(columns, lows, highs).alias("bins"), key.alias("key"), target.alias("target"))
    most = rows.agg(F.max(F.abs("target"))).first()[0]
    if most is None:
        raise ValueError("no row has a target")
    scale = 2.0 ** (GRADIENT_BITS - int(np.ceil(np.log2(most))) if most else 0)
    whole, n = rows.agg(F.sum(F.rint(F.col("target") * F.lit(scale)).cast("long")), F.count("target")).first()
    base = whole / scale / n
    return rows.where("target IS NOT NULL").withColumn("score", F.lit(base)), base, scale


def first_splits(df: DataFrame, columns: Sequence[str], lows: Sequence[float], highs: Sequence[float], target: Column, key: Column, config: ModelConfig) -> list[Split | None]:
    """Of each column the best split of the first tree's root."""
    rows, _, scale = prepared(df, columns, lows, highs, target, key)
    found = _read(histograms(rows, [], Tree(), [0], sampled(len(columns), 0, config.random_state, config.colsample_bytree), 0, scale, config), len(columns))
    return best_splits(*found[0], scale, config) if found else [None] * len(columns)


def fit(df: DataFrame, columns: Sequence[str], lows: Sequence[float], highs: Sequence[float], target: Column, key: Column, config: ModelConfig) -> Booster:
    """Trees for squared loss with L1 and L2 in the gain, best-first leaves, rows
    and columns drawn anew for each tree, and a learned way for missing values.

    Rows whose key is the same are drawn together. Rows without a target are
    left out. Fitting ends early where no split gains on a whole sample."""
    rows, base, scale = prepared(df, columns, lows, highs, target, key)
    rows = rows.persist()
    whole = config.subsample >= 1 and config.colsample_bytree >= 1
    trees: list[Tree] = []
    since: list[Tree] = []
    held = rows
    try:
        for number in range(config.n_estimators):
            tree = grow(held, since, len(columns), number, scale, config)
            if tree is None:
                if whole:
                    break
                continue
            trees.append(tree)
            since.append(tree)
            if len(since) == WRITTEN_TREES and number + 1 < config.n_estimators:
                before, held, since = held, _written(held, since), []
                before.unpersist()
                held = held.persist()
    finally:
        held.unpersist()
        rows.unpersist()
    return Booster(tuple(columns), tuple(lows), tuple(highs), base, tuple(trees))
