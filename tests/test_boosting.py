import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.config import ModelConfig
from panelwright.operators import boosting as bo


def plain_fit(rows, features, base, scale, c):
    """The same trees by looping over all rows, features, bins and ways: rows of (bins, key, target)."""
    score, out = [base] * len(rows), []

    def part(g, n):
        return max(abs(g / scale) - c.reg_alpha, 0) ** 2 / (n + c.reg_lambda)

    for number in range(c.n_estimators):
        used = bo.sampled(features, number, c.random_state, c.colsample_bytree)
        bag = bo.bagged(np.array([k for _, k, _ in rows]), number, c.random_state, c.subsample)
        grads = [round((s - t) * scale) for s, (_, _, t) in zip(score, rows, strict=True)]

        def best(at, grads=grads, used=used):
            found, g, n = None, sum(grads[i] for i in at), len(at)
            for f in used:
                for cut in range(255):
                    for missing in (False, True):
                        left = [i for i in at if (missing if rows[i][0][f] == 255 else rows[i][0][f] <= cut)]
                        if len(left) < c.min_child_samples or n - len(left) < c.min_child_samples:
                            continue
                        lg = sum(grads[i] for i in left)
                        gain = part(lg, len(left)) + part(g - lg, n - len(left)) - part(g, n)
                        if gain > 0 and (found is None or gain > found[0]):
                            found = gain, f, cut, missing
            return found

        def sides(at, s):
            left = [i for i in at if (s[3] if rows[i][0][s[1]] == 255 else rows[i][0][s[1]] <= s[2])]
            return left, [i for i in at if i not in set(left)]

        everyone, bagged = list(range(len(rows))), [i for i in range(len(rows)) if bag[i]]
        leaves, splits = [(everyone, bagged, best(bagged), 0)], []
        while len(leaves) < c.num_leaves:
            able = [x for x in leaves if x[2] and (c.max_depth <= 0 or x[3] < c.max_depth)]
            if not able:
                break
            leaf = max(able, key=lambda x: x[2][0])
            leaves.remove(leaf)
            a, b = sides(leaf[0], leaf[2]), sides(leaf[1], leaf[2])
            leaves += [(a[k], b[k], best(b[k]), leaf[3] + 1) for k in (0, 1)]
            splits.append(leaf[2][1:])
        for whole, sample, _, _ in leaves:
            g = sum(grads[i] for i in sample)
            value = -c.learning_rate * math.copysign(1, g) * max(abs(g / scale) - c.reg_alpha, 0) / (len(sample) + c.reg_lambda)
            for i in whole:
                score[i] += value if len(leaves) > 1 else 0
        out.append(splits)
    return out, score


def table(spark, n, seed):
    rng = random.Random(seed)
    cell = lambda: None if rng.random() < 0.15 else round(rng.uniform(-0.5, 0.5), 1 + rng.randrange(3))
    rows = [(i, *(cell() for _ in range(3))) for i in range(n)]
    rows = [(*r, (0.4 if r[1] is None else r[1]) + (0.3 if (r[2] or 0) > 0.1 else 0) + rng.gauss(0, 0.05)) for r in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").withColumn("k", F.xxhash64("id"))


@pytest.mark.parametrize("more", [{}, {"subsample": 0.7, "colsample_bytree": 0.67}, {"max_depth": 2, "reg_alpha": 0.0, "reg_lambda": 0.0}])
def test_same_trees_as_by_loops(spark, monkeypatch, more):
    monkeypatch.setattr(bo, "WRITTEN_TREES", 2)
    c = ModelConfig(**{"n_estimators": 3, "num_leaves": 5, "min_child_samples": 8, "learning_rate": 0.3, **more})
    df, names, ends = table(spark, 120, 3), ["a", "b", "c"], ([-0.5] * 3, [0.5] * 3)
    rows, base, scale = bo.prepared(df, names, *ends, F.col("y"), F.col("k"))
    held = [(r["bins"], r["key"], r["target"]) for r in rows.collect()]
    splits, score = plain_fit(held, 3, base, scale, c)
    fits = [bo.fit(df.repartition(p), names, *ends, F.col("y"), F.col("k"), c) for p in (1, 5)]
    assert fits[0] == fits[1]  # whatever the partitions
    for tree, plain in zip(fits[0].trees, splits, strict=True):
        assert sorted((f, b, m) for f, b, m in zip(tree.feature, tree.bin, tree.missing_left, strict=True) if f >= 0) == sorted(plain)
    got = {r["k"]: r["model_score"] for r in fits[0].predict(df).collect()}
    assert all(abs(got[k] - s) < 1e-9 for (_, k, _), s in zip(held, score, strict=True))


def test_missing_values_learn_their_way(spark):
    """Rows without a value behave as the high ones, or as the low ones."""
    c = ModelConfig(n_estimators=1, num_leaves=2, min_child_samples=5, learning_rate=1.0, subsample=1.0, colsample_bytree=1.0)
    for like in (0.0, 1.0):
        rows = [(i, None if i % 3 == 0 else i / 300 - 0.5, like if i % 3 == 0 else float(i >= 150)) for i in range(300)]
        df = spark.createDataFrame(rows, "k long, a double, y double")
        tree = bo.fit(df, ["a"], [-0.5], [0.5], F.col("y"), F.col("k"), c).trees[0]
        assert tree.missing_left[0] == (like == 0.0) and len(tree.feature) == 3


def test_nothing_gains_and_no_rows(spark):
    c = ModelConfig(n_estimators=4, num_leaves=4, min_child_samples=5)
    df = spark.createDataFrame([(i, i / 50 - 0.5, 0.25) for i in range(50)], "k long, a double, y double")
    model = bo.fit(df, ["a"], [-0.5], [0.5], F.col("y"), F.col("k"), c)
    assert not model.trees and model.base == 0.25 and {r["model_score"] for r in model.predict(df).collect()} == {0.25}
    with pytest.raises(ValueError):
        bo.fit(df.limit(0), ["a"], [-0.5], [0.5], F.col("y"), F.col("k"), c)
