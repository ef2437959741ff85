"""Gradient-boosted trees on ranks, fitted on leakage-safe windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import AppConfig, ModelConfig
from .boosting import fit
from .features import PreparedData, labelled
from .selection import as_of_index, with_selection_score

MODEL_TYPE = "histogram_gbdt_regression_l2"


@dataclass(frozen=True)
class FitDiagnostics:
    rows: int
    total_features: int
    active_features: int
    target_mean: float
    target_std: float
    model_type: str
    trained_trees: int


#: Scores: (rows to train on, rows to score, feature columns, settings) -> the
#: latter with model_score, and the diagnostics of the fit.
Scorer = Callable[[DataFrame, DataFrame, Sequence[str], ModelConfig], tuple[DataFrame, FitDiagnostics]]


def _bounds(q: float, target: str) -> list[Column]:
    return [F.percentile(target, F.array(F.lit(q), F.lit(1 - q)))] if 0 < q < 0.5 else []


def winsor_bounds(train: DataFrame, q: float, target: str = "target_rank") -> tuple[float, float] | None:
    """The exact q and 1 - q quantiles (linear between values), None if q is 0."""
    found = _bounds(q, target)
    return tuple(train.agg(*found).first()[0]) if found else None


def _spans(columns: Sequence[str]) -> list[Column]:
    """Of each column 1e-10 or less is no range; one value has none."""
    return [F.coalesce((F.count(c) >= 2) & (F.max(c) - F.min(c) > 1e-10), F.lit(False)) for c in columns]


def active_features(train: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those with two values or more and a range above 1e-10, in one aggregation."""
    row = train.agg(*(s.alias(f"x{i}") for i, s in enumerate(_spans(columns)))).first()
    return [c for c, varies in zip(columns, row, strict=True) if varies]


@dataclass(frozen=True)
class FitInput:
    """Rows with a key, the features that vary with their ranges, and the clipped target."""

    rows: DataFrame
    n: int
    active: tuple[str, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]
    target: Column
    key: Column


def fit_input(train: DataFrame, columns: Sequence[str], config: ModelConfig) -> FitInput:
    """Persists its rows. Targets are clipped to the winsor bounds; constant
    features are left out."""
    named = [c for c in ("date", "code") if c in train.columns]
    key = F.xxhash64(*(named or columns)).alias("key of row")
    rows = train.where(F.col("target_rank").isNotNull()).select(*columns, "target_rank", key).persist()
    try:
        # all that is to be known of the rows, in one pass
        ends = [F.struct(F.min(c).cast("double"), F.max(c).cast("double")) for c in columns]
        facts = [F.count("*"), *_spans(columns), *ends, *_bounds(config.target_winsor_quantile, "target_rank")]
        n, *known = rows.agg(*(x.alias(f"x{i}") for i, x in enumerate(facts))).first()
        if n < 2:
            raise ValueError("fewer than two rows with a target")
        k = len(columns)
        active = [(c, *span) for c, varies, span in zip(columns, known[:k], known[k : 2 * k], strict=True) if varies]
        if not active:
            raise ValueError("all features are constant or missing")
    except BaseException:
        rows.unpersist()
        raise
    target = F.col("target_rank").cast("double")
    for low, high in known[2 * k :]:
        target = F.least(F.greatest(target, F.lit(low)), F.lit(high))
    return FitInput(rows, n, *zip(*active, strict=True), target, F.col("key of row"))


def fit_and_predict(train: DataFrame, score: DataFrame, columns: Sequence[str], config: ModelConfig) -> tuple[DataFrame, FitDiagnostics]:
    """Boosted trees (see boosting)."""
    x = fit_input(train, columns, config)
    try:
        mean, std = x.rows.agg(F.avg(x.target), F.stddev_pop(x.target)).first()
        model = fit(x.rows, x.active, x.lows, x.highs, x.target, x.key, config)
    finally:
        x.rows.unpersist()
    return model.predict(score), FitDiagnostics(x.n, len(columns), len(x.active), mean, std, MODEL_TYPE, len(model.trees))


@dataclass(frozen=True)
class LinearScore:
    """A Scorer: a fixed weighting of ranks (missing ones count 0) in place of a
    model. Its value asks nothing of the training rows, so a backtest scores all
    dates at once."""

    weights: dict[str, float]

    def value(self) -> Column:
        return sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in self.weights.items()), F.lit(0.0))

    def __call__(self, train: DataFrame, score: DataFrame, columns: Sequence[str], config: ModelConfig) -> tuple[DataFrame, FitDiagnostics]:
        k = len(self.weights)
        return score.withColumn("model_score", self.value()), FitDiagnostics(train.count(), k, k, 0.0, 0.0, "linear", 0)


@dataclass(frozen=True)
class Scored:
    rows: DataFrame
    diagnostics: FitDiagnostics
    score_date: str
    training_start: str
    training_end: str
    training_days: int


@dataclass(frozen=True)
class Span:
    """The places in the calendar of the dates that a model of (date, at) may learn from."""

    date: str
    at: int
    first: int
    last: int

    def rows(self, frame: DataFrame) -> DataFrame:
        return frame.where(F.col("date_idx").between(self.first, self.last) & F.col("eligible") & labelled(frame))

    def scored_rows(self, frame: DataFrame) -> DataFrame:
        return frame.where((F.col("date_idx") == self.at) & F.col("eligible"))

    def check(self, known: int, eligible: int, config: ModelConfig) -> None:
        if known < config.min_train_rows:
            raise ValueError(f"{known} training rows before {self.date}; {config.min_train_rows} are needed")
        if not eligible:
            raise ValueError(f"nothing is eligible on {self.date}")


def training_span(config: AppConfig, date: str, at: int) -> Span:
    """The last train_lookback_days dates whose labels are known by the score date
    (the last one ends horizon + 1 earlier)."""
    m = config.model
    last = at - config.features.prediction_horizon - 1
    if last < 0:
        raise ValueError(f"no label is known by {date}")
    first = max(0, last - m.train_lookback_days + 1)
    if last - first + 1 < m.min_train_days:
        raise ValueError(f"{last - first + 1} training dates before {date}; {m.min_train_days} are needed")
    return Span(date, at, first, last)


@dataclass(frozen=True)
class TrainingWindow:
    """The rows that a model of (date, at) may be trained on: dates first to last."""

    rows: DataFrame
    date: str
    at: int
    first: int
    last: int


def training_window(frame: DataFrame, config: AppConfig, as_of: str | None = None) -> TrainingWindow:
    """Eligible rows with a target, of the training_span of the last date up to as_of."""
    span = training_span(config, *as_of_index(frame, as_of))
    return TrainingWindow(span.rows(frame), span.date, span.at, span.first, span.last)


@dataclass(frozen=True)
class Day:
    """A date's place in the calendar, its rows to learn from and to score."""

    date: str
    at: int
    known: int
    eligible: int


def day_counts(frame: DataFrame) -> list[Day]:
    """All dates in order: one aggregation, a row per date."""
    eligible = F.col("eligible")
    known = F.count_if(eligible & labelled(frame))
    rows = frame.groupBy("date", "date_idx").agg(known.alias("known"), F.count_if(eligible).alias("eligible")).orderBy("date_idx").collect()
    return [Day(r["date"].isoformat(), r["date_idx"], r["known"], r["eligible"]) for r in rows]


def checked_spans(days: Sequence[Day], dates: Sequence[tuple[str, int]], config: AppConfig) -> list[Span]:
    """The training_span of each of these dates; the rows in each come from
    running sums over the days, so no window is read for its guards."""
    eligible, before = {d.at: d.eligible for d in days}, [0] * (days[-1].at + 2)
    for d in days:
        before[d.at + 1] = d.known
    before = list(accumulate(before))
    spans = [training_span(config, date, at) for date, at in dates]
    for s in spans:
        s.check(before[s.last + 1] - before[s.first], eligible[s.at], config.model)
    return spans


def fit_and_score(prepared: PreparedData, config: AppConfig, as_of: str | None = None, scorer: Scorer = fit_and_predict) -> Scored:
    """Trains on the window of the score date, scores its eligible rows."""
    frame, m = prepared.frame, config.model
    s = training_span(config, *as_of_index(frame, as_of))
    # what the guards and the report ask, in one pass over the dates from the window to the score date
    day = lambda i: F.date_format(F.max(F.when(F.col("date_idx") == i, F.col("date"))), "yyyy-MM-dd")
    trains = (F.col("date_idx") <= s.last) & labelled(frame)
    facts = (F.count_if(F.col("eligible") & trains), F.count_if(F.col("eligible") & (F.col("date_idx") == s.at)), day(s.first), day(s.last))
    known, eligible, start, end = frame.where(F.col("date_idx").between(s.first, s.at)).agg(*(x.alias(f"x{i}") for i, x in enumerate(facts))).first()
    s.check(known, eligible, m)
    rows, diagnostics = scorer(s.rows(frame), s.scored_rows(frame), prepared.feature_columns, m)
    return Scored(with_selection_score(rows, config.selection), diagnostics, s.date, start, end, s.last - s.first + 1)
