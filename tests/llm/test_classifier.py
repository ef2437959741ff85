import random

import numpy as np
import pytest

from panelwright.llm import classifier as c

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grade string, tail string"


def corpus(n, rng):
    rows, labels = [], []
    words = [f"w{i}" for i in range(3000)]
    for i in range(n):
        kind = rng.choice([0, 1, 2, 2, 2])
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        if kind == 0:
            text[rng.randrange(len(text))] = rng.choice(["nasty", "vile"])
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(kind != 1), int(kind == 0)))
    return rows, labels


def test_gradient_reaches_the_optimum():
    """The fitted penalised likelihood is no worse than at nearby weights."""
    rng = np.random.default_rng(0)
    index = [np.unique(rng.integers(0, 6, 3)).astype(np.int32) for _ in range(400)]
    values = [np.ones(len(x), np.float32) for x in index]
    truth = np.array([2.0, -2, 1, 0, 0, -1])
    noise = np.log(1 / rng.random(400) - 1)
    grades = np.digitize([truth[x].sum() for x in index] + noise, [-1, 1])
    settings = c.Settings(least_docs=1, least_z=0, ridge=0.5, rounds=1500)
    model = c.fit(index, values, grades, 3, settings)

    def loss(w, t):
        s = np.array([w[x].sum() for x in index])
        edges = np.hstack([np.ones((400, 1)), c._tails(s, t), np.zeros((400, 1))])
        return -np.log(edges[np.arange(400), grades] - edges[np.arange(400), grades + 1]).sum() + 0.25 * (w**2).sum()

    w = model.weights[:6].astype(float)
    best = loss(w, model.thresholds)
    for _ in range(200):
        assert loss(w + rng.normal(0, 0.05, 6), model.thresholds + rng.normal(0, 0.05, 2)) > best - 1e-3
    assert np.sign(w[:3]).tolist() == [1, -1, 1]


def test_held_out_accuracy_and_stage(spark, tmp_path):
    rows, labels = corpus(1500, random.Random(1))
    df = spark.createDataFrame([(*r, "en", "s", 1, "x", "y") for r in rows], DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 3] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = {r.doc_id: r for r in c.op3_classifier(spark, str(tmp_path)).collect()}
    held = [x for x in labels if not x[0] % 3]
    right = [found[k].kept == (q == 1 and t == 0) for k, q, t in held]
    assert np.mean(right) > 0.97
    for r in found.values():
        assert 0 <= r.p_good <= r.p_not_toxic <= 1 and r.expected_grade == pytest.approx(r.p_good + r.p_not_toxic)
    docs = df.union(spark.createDataFrame([(None, None, None, None, None, None, None), (5000, "", "en", "s", 0, "x", "y"), (5001, "w1 " * 100000, "en", "s", 0, "x", "y")], DOCS))
    kept = c.keep_good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {k for k, r in found.items() if r.kept}
    assert c.keep_good(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_no_labels_keeps_all(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en", "s", 3, "", "")], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.kept for r in c.op3_classifier(spark, str(tmp_path)).collect()] == [True]
