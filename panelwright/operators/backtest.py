"""Selection for a date, and walk-forward backtests."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig
from ..sources.market import load_market_data, previous_codes
from . import metrics
from .features import PreparedData, build_features
from .model import LinearScore, Scorer, Span, checked_spans, day_counts, fit_and_predict, fit_and_score, training_span
from .selection import as_of_index, chained_top_k, constrained_top_k, industry_cap, with_selection_score


@dataclass(frozen=True)
class SelectionDiagnostics:
    model_type: str
    score_date: str
    training_start: str
    training_end: str
    training_days: int
    training_rows: int
    eligible_stocks: int
    selected_stocks: int
    active_features: int
    trained_trees: int
    industry_cap: int


@dataclass(frozen=True)
class SelectionResult:
    """codes: the basket's, in its order. held: the persisted rows that both
    frames read (one date's universe, and its basket); release() when done."""

    candidates: DataFrame
    scored_universe: DataFrame
    diagnostics: SelectionDiagnostics
    codes: list[str]
    held: tuple[DataFrame, ...]

    def release(self) -> None:
        for frame in self.held:
            frame.unpersist()


@dataclass(frozen=True)
class BacktestResult:
    periods: DataFrame
    holdings: DataFrame
    summary: dict[str, Any]


def score_dates(frame: DataFrame, config: AppConfig, start: str | None = None, end: str | None = None) -> list[tuple[str, int]]:
    """(date, date_idx) of each period (see period_dates)."""
    rows = frame.select("date", "date_idx").distinct().orderBy("date_idx").collect()
    return period_dates([(r["date"].isoformat(), r["date_idx"]) for r in rows], config, start, end)


def period_dates(days: Sequence[tuple[str, int]], config: AppConfig, start: str | None = None, end: str | None = None) -> list[tuple[str, int]]:
    """Of all dates in order: from the first date with enough training dates to
    the last with a known label, every rebalance_every_days; of these within start
    and end the last max_periods (all if that is 0 or None)."""
    horizon = config.features.prediction_horizon
    first, stop = config.model.min_train_days + horizon + 1, len(days) - horizon - 1
    if stop <= first:
        raise ValueError(f"{len(days)} dates are too few for a backtest")
    found = [d for d in days[first : stop : config.backtest.rebalance_every_days] if (not start or d[0] >= start) and (not end or d[0] <= end)]
    found = found[-(config.backtest.max_periods or 0) :]
    if not found:
        raise ValueError("no score dates in the period")
    return found


_NEEDED = ["volatility_20_cs", "amihud_20_cs", "date_idx", "forward_return", "target_excess_return", "target_rank"]
# The columns of each report, in order; those a frame lacks are left out.
CANDIDATES = (
    "date", "code", "ts_code", "name", "industry", "market", "exchange", "candidate_position", "global_rank", "selection_score", "alpha_percentile",
    "model_score", "selection_reason", "close", "avg_amount_liquidity", "volatility_20", "momentum_5", "momentum_20", "momentum_60", "amount_ratio_20",
    "price_position_20", "is_limit_up", "is_limit_down",
)
UNIVERSE = (
    "date", "code", "ts_code", "name", "industry", "market", "exchange", "global_rank", "selection_score", "alpha_percentile", "model_score", "close",
    "avg_amount_liquidity", "eligible",
)
_HELD = ["date", "code", "industry", "candidate_position", "global_rank", "selection_score", "forward_return", "target_excess_return", "selection_reason"]


class CandidateSelector:
    def __init__(self, config: AppConfig, scorer: Scorer = fit_and_predict, fits_at_once: int = 4) -> None:
        self.config, self.scorer, self.fits_at_once = config, scorer, fits_at_once

    def prepare(self, panel: DataFrame) -> PreparedData:
        return build_features(panel, self.config)

    def prepare_from_csv(self, spark: SparkSession, path: str) -> PreparedData:
        return self.prepare(load_market_data(spark, path, self.config))

    def _lean(self, prepared: PreparedData, report: Sequence[str]) -> PreparedData:
        """The columns of the score, the report and the metrics, persisted. A fixed
        score reads its own features only, so the ranks of the others aren't made."""
        features = prepared.feature_columns
        if isinstance(self.scorer, LinearScore):
            features = [c for c in self.scorer.weights if c in prepared.frame.columns]
        wanted = dict.fromkeys([*features, *_NEEDED, *report])
        return PreparedData(prepared.frame.select(*(c for c in wanted if c in prepared.frame.columns)).persist(), features)

    def select_prepared(self, prepared: PreparedData, as_of: str | None = None, previous: Iterable[str] | None = None) -> SelectionResult:
        """Of one date. The columns that are needed, of the dates from the training
        window to the score date (no others are ranked), are persisted while the
        model is fitted (guards, window and scores read them), and the scored
        universe for its results: it is at most the rows of that date."""
        lean = prepared
        if not prepared.frame.is_cached:
            s = training_span(self.config, *as_of_index(prepared.frame, as_of))
            dates = prepared.frame.where(F.col("date_idx").between(s.first, s.at))
            lean = self._lean(PreparedData(dates, prepared.feature_columns), (*CANDIDATES, *UNIVERSE))
        scored = fit_and_score(lean, self.config, as_of, self.scorer)
        universe = scored.rows.persist()
        eligible = universe.count()
        if lean is not prepared:
            lean.frame.unpersist()
        basket = constrained_top_k(universe, self.config.selection, previous).persist()
        codes = [r["code"] for r in basket.orderBy("candidate_position").select("code").collect()]
        d = scored.diagnostics
        found = SelectionDiagnostics(
            d.model_type, scored.score_date, scored.training_start, scored.training_end, scored.training_days, d.rows, eligible, len(codes), d.active_features, d.trained_trees, industry_cap(self.config.selection)
        )
        return SelectionResult(basket.orderBy("candidate_position"), universe.orderBy("global_rank"), found, codes, (universe, basket))

    def select_from_csv(self, spark: SparkSession, path: str, as_of: str | None = None, previous_path: str | None = None) -> SelectionResult:
        before = previous_codes(spark, previous_path) if previous_path else None
        return self.select_prepared(self.prepare_from_csv(spark, path), as_of, before)

    def backtest_prepared(self, prepared: PreparedData, start_date: str | None = None, end_date: str | None = None) -> BacktestResult:
        """All periods together over the persisted features: guards from one
        aggregation by date, scores and ranks of all dates in one pass, metrics
        likewise. Fits don't depend on each other and run `fits_at_once` at a
        time. Only the baskets follow one another (see chained_top_k)."""
        lean = self._lean(prepared, ("date", "code", "industry", "eligible"))
        universe = None
        try:
            days = day_counts(lean.frame)
            dates = period_dates([(d.date, d.at) for d in days], self.config, start_date, end_date)
            scored = self._scored(lean, checked_spans(days, dates, self.config))
            universe = with_selection_score(scored, self.config.selection).persist()
            held = chained_top_k(universe, self.config.selection)
            periods = self._periods(universe, held).persist()
            holdings = held.orderBy("date", "candidate_position").select(*_HELD).persist()
            summary = self._summary(periods)
            holdings.count()
        finally:
            lean.frame.unpersist()
            if universe is not None:
                universe.unpersist()
        return BacktestResult(periods, holdings, summary)

    def _scored(self, lean: PreparedData, spans: Sequence[Span]) -> DataFrame:
        """The eligible rows of each span's score date, with model_score and period."""
        spark = lean.frame.sparkSession
        if isinstance(self.scorer, LinearScore):
            numbered = spark.createDataFrame([(s.at, i) for i, s in enumerate(spans)], "date_idx int, period int")
            rows = lean.frame.where("eligible").join(F.broadcast(numbered), "date_idx")
            return rows.withColumn("model_score", self.scorer.value())

        def scored(period: int) -> DataFrame:
            # a pool each, so that under fair scheduling no fit waits for another's tasks
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit {period % self.fits_at_once}")
            s = spans[period]
            rows, _ = self.scorer(s.rows(lean.frame), s.scored_rows(lean.frame), lean.feature_columns, self.config.model)
            return rows.withColumn("period", F.lit(period))

        with ThreadPoolExecutor(self.fits_at_once) as pool:
            return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(spark)(scored), range(len(spans))))

    @staticmethod
    def _periods(scored: DataFrame, held: DataFrame) -> DataFrame:
        by = ("period", "date")
        out = metrics.basket_metrics(held, by).join(scored.groupBy("period").agg(F.count("*").alias("eligible_count")), "period")
        out = out.join(metrics.spearman_ic(scored, ("period",)), "period", "left").join(metrics.turnover(held), "period", "left")
        columns = ["candidate_count", "eligible_count", "basket_forward_return", "basket_excess_return", "positive_excess_rate", "precision_top_20pct", "spearman_ic", "turnover"]
        return out.orderBy("period").select("date", *columns)

    def _summary(self, periods: DataFrame) -> dict[str, Any]:
        c, step = self.config, self.config.backtest.rebalance_every_days
        means = {
            "mean_basket_forward_return": "basket_forward_return", "mean_basket_excess_return": "basket_excess_return",
            "mean_precision_top_20pct": "precision_top_20pct", "mean_spearman_ic": "spearman_ic", "mean_turnover": "turnover",
        }
        row = periods.agg(
            F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"),
            *(F.avg(x).alias(k) for k, x in means.items()), metrics.sharpe(step, F.col("basket_forward_return")).alias("sharpe"),
        ).first()
        head = {"start_date": row["start"].isoformat(), "end_date": row["end"].isoformat(), "periods": row["n"], "top_k": c.selection.top_k}
        head |= {"prediction_horizon_days": c.features.prediction_horizon, "rebalance_every_days": step}
        return head | {k: row[k] for k in means} | {"period_return_sharpe": row["sharpe"]}
