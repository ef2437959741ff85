"""Ordinal quality classifier: cumulative-link regression on hashed text.

Ratings are grades 0 < 1 < ... < K-1. One weight vector is shared by all grades
and ordered thresholds t_0 < t_1 < ... split the score:
P(grade <= k) = sigmoid(t_k - w.x). The model is fitted on a bounded sample of
rated documents (`max_rated`, in the order of a hash of their ids) and gives
every document its expected grade and the tail probability of each grade.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ._common import table, texts

BITS = 22
_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_CAPITALS = re.compile(rb"[A-Z]+")
_DIGITS = re.compile(rb"[0-9]+")
_MARKS = re.compile(rb"([^aA0])\1+")


@dataclass(frozen=True)
class Settings:
    """max_rated: rated documents that the fit may use. least_docs: documents
    of the sample that a feature must occur in. least_z: score statistic that a
    feature must reach on its own (sure screening: most words of a large
    vocabulary say nothing of a grade, and would only add noise). ridge: L2
    penalty on weights."""

    max_rated: int = 12_000
    least_docs: int = 3
    least_z: float = 2.5
    ridge: float = 1.0
    rounds: int = 200
    step: float = 0.05


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    rated: int

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1


def _shape(word: bytes) -> bytes:
    return _MARKS.sub(rb"\1", _DIGITS.sub(b"0", _CAPITALS.sub(b"A", _LETTERS.sub(b"a", word))))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values) of the whole text: its distinct words, lower-
    cased and without marks around them, and the magnitude of its length at 1;
    its word shapes and the words that repeat the one before at their shares."""
    words = text.split()
    mask = (1 << BITS) - 1
    plain = {w.strip(b".,;:!?\"'()[]|*#$%&<>") for w in text.lower().split()}
    plain.discard(b"")
    index = [zlib.crc32(w) & mask for w in plain]
    shapes: Counter[bytes] = Counter()
    for word, n in Counter(words).items():
        shapes[_shape(word)] += n
    index += [zlib.crc32(b"\0" + s) & mask for s in shapes]
    index += [zlib.crc32(b"\1%d" % len(words).bit_length()) & mask, zlib.crc32(b"\1again") & mask]
    values = np.ones(len(index), np.float32)
    if words:
        values[len(plain) : -2] = [3.0 * n / len(words) for n in shapes.values()]
    values[-1] = 3.0 * sum(map(eq, words, words[1:])) / max(1, len(words))
    return np.array(index, np.int32), values


def _tails(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K-1, a column each."""
    return 1.0 / (1.0 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -40, 40)))


def fit(index: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, n_grades: int, settings: Settings = Settings()) -> Model:
    """Maximum likelihood with a ridge penalty, by Adam over the whole sample.
    Without rated documents all weights are 0 and `rated` is 0."""
    n = len(grades)
    size = 1 << BITS
    counts = np.bincount(grades, minlength=n_grades) + 0.5
    below = np.cumsum(counts)[:-1] / counts.sum()
    thresholds = np.log(below / (1 - below))
    if not n:
        return Model(np.zeros(size, np.float32), thresholds, 0)
    flat, value = np.concatenate(index), np.concatenate(values)
    row = np.repeat(np.arange(n), [len(x) for x in index])
    # score statistic of each feature where all weights are 0
    edges = np.concatenate([[1.0], 1 - below, [0.0]])
    slope = edges * (1 - edges)
    pull = ((slope[:-1] - slope[1:]) / -np.diff(edges))[grades]
    moved = np.bincount(flat, value * pull[row], size)
    spread = np.bincount(flat, value * value, size) * pull.var()
    used = (np.bincount(flat, minlength=size) >= settings.least_docs) & (moved * moved >= settings.least_z**2 * np.maximum(spread, 1e-12))
    names = np.flatnonzero(used)
    keep = used[flat]
    column, value, row = np.searchsorted(names, flat[keep]), value[keep].astype(np.float64), row[keep]
    w = np.zeros(len(names))
    # thresholds as the first and logarithms of the gaps, so that they stay ordered
    t = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    moments = [np.zeros(len(w) + len(t)) for _ in range(2)]
    for i in range(1, settings.rounds + 1):
        cuts = t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))])
        scores = np.bincount(row, value * w[column], n)
        edges = np.hstack([np.ones((n, 1)), _tails(scores, cuts), np.zeros((n, 1))])  # P(grade >= k)
        upper, lower = edges[np.arange(n), grades], edges[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        by_score = (du - dl) / p  # of the log-likelihood
        by_cut = np.zeros(n_grades + 1)
        np.add.at(by_cut, grades, -du / p)
        np.add.at(by_cut, grades + 1, dl / p)
        by_cut = by_cut[1:-1]
        by_t = np.concatenate([[by_cut.sum()], np.exp(t[1:]) * (by_cut.sum() - np.cumsum(by_cut))[:-1]])
        down = np.concatenate([settings.ridge * w - np.bincount(column, value * by_score[row], len(w)), -by_t])
        moments[0] = 0.9 * moments[0] + 0.1 * down
        moments[1] = 0.999 * moments[1] + 0.001 * down * down
        move = settings.step * (moments[0] / (1 - 0.9**i)) / (np.sqrt(moments[1] / (1 - 0.999**i)) + 1e-8)
        w -= move[: len(w)]
        t -= move[len(w) :]
    weights = np.zeros(size, np.float32)
    weights[names] = w
    return Model(weights, t[0] + np.concatenate([[0.0], np.cumsum(np.exp(t[1:]))]), n)


def grade(quality: str = "quality", toxic: str = "toxic"):  # noqa: ANN201
    """The graded rating of a labels row: 0 toxic, 1 poor, 2 good."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 1, 2).otherwise(1)


def train(docs: DataFrame, ratings: DataFrame, n_grades: int, settings: Settings = Settings()) -> Model:
    """ratings: doc_id, grade. Rows without either, and grades out of range,
    don't count. The sampled ratings are at most max_rated rows, and so may be
    broadcast; the documents' whole texts are hashed where they lie."""
    sample = (
        ratings.select(F.col("doc_id").cast("long").alias("rated_id"), F.col("grade").cast("int").alias("grade"))
        .where(F.col("rated_id").isNotNull() & F.col("grade").between(0, n_grades - 1))
        .orderBy(F.xxhash64("rated_id"), "rated_id", "grade")
        .limit(settings.max_rated)
    )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grades, found in texts(batches):
            made = [features(x) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(grades, pa.int32()), pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([v.tobytes() for _, v in made], pa.binary())],
                ["grade", "index", "value"],
            )

    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), F.col("doc_id") == F.col("rated_id"))
    rows = joined.select("grade", "text").mapInArrow(of, "grade int, index binary, value binary").toArrow()
    order = sorted(range(rows.num_rows), key=lambda i: (rows["grade"][i].as_py(), rows["index"][i].as_py()))
    grades = np.array([rows["grade"][i].as_py() for i in order], np.int64)
    index = [np.frombuffer(rows["index"][i].as_py(), np.int32) for i in order]
    values = [np.frombuffer(rows["value"][i].as_py(), np.float32) for i in order]
    return fit(index, values, grades, n_grades, settings)


def score(docs: DataFrame, model: Model, columns: list[str], names: tuple[str, str] = ("expected_grade", "tail")) -> DataFrame:
    """columns of docs, then the expected grade and the array of P(grade >= k)
    for k = 1 .. K-1, under names that columns don't have. The weights are one
    array of fixed size, sent once."""
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    kinds = docs.select(columns).schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = sent.value
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            scores = np.zeros(batch.num_rows)
            for i, x in enumerate(text):
                index, value = features((x.as_py() or "").encode("utf-8", "replace"))
                scores[i] = float(np.dot(weights[index].astype(np.float64), value))
            tails = _tails(scores, cuts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))],
                [*columns, *names],
            )

    schema = StructType([*kinds.fields, StructField(names[0], DoubleType()), StructField(names[1], ArrayType(DoubleType()))])
    return docs.select(*columns, F.col("text").cast("string").alias("scored text")).mapInArrow(of, schema)


def labelled_model(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> Model:
    labels = table(spark, sf_dir, "labels").select("doc_id", grade().alias("grade"))
    return train(table(spark, sf_dir, "documents"), labels, 3, settings)


def is_kept(model: Model, tail: str) -> Column:
    """The best grade is at least as likely as not (all are kept without rated rows)."""
    return F.lit(model.rated == 0) | (F.element_at(tail, -1) >= 0.5)


def op3_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its expected grade, P(grade >= 1), P(grade >= 2) and
    whether it is kept. Null or empty text has no features: the thresholds alone
    decide. Repeated rows score alike; null ids are scored, never rated."""
    model = labelled_model(spark, sf_dir)
    found = score(table(spark, sf_dir, "documents"), model, ["doc_id"])
    p_good, p_not_toxic = F.get("tail", F.lit(1)), F.get("tail", F.lit(0))
    return found.select("doc_id", "expected_grade", p_not_toxic.alias("p_not_toxic"), p_good.alias("p_good"), is_kept(model, "tail").alias("kept"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go."""
    columns, names = docs.columns, ("grade of stage", "tail of stage")
    model = labelled_model(spark, sf_dir)
    return score(docs, model, columns, names).where(is_kept(model, names[1])).select(columns)
