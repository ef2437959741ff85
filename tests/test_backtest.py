"""Walk-forward backtests: the basket chain, the number of jobs, fits side by side."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.config import SelectionConfig
from panelwright.operators.backtest import CandidateSelector
from panelwright.operators.model import FitDiagnostics, LinearScore, day_counts, fit_and_score
from panelwright.operators.selection import chained_top_k, constrained_top_k, contenders
from panelwright.plans.fixture import config, panel

SF = "/root/testdata/sf0.001"
WEIGHTS = {"momentum_20_cs": 1.0, "volatility_20_cs": -0.5}


@pytest.mark.parametrize(("k", "share", "buffer"), [(7, 0.3, 1.5), (3, 0.34, 4.0), (5, 1.0, 1.0), (4, 0.1, 2.0)])
def test_the_chain_equals_a_basket_after_the_other(spark, k, share, buffer):
    rng = random.Random(k)
    c = SelectionConfig(top_k=k, max_industry_fraction=share, buffer_exit_multiplier=buffer)
    rows = []
    for period in range(12):
        n = rng.choice((1, 2, 10, 40, 80))
        codes = rng.sample(range(90), n)
        rows += [(period, f"{code:06d}", rng.choice(["a", "b", "c", "d", None]), rank) for rank, code in enumerate(codes, 1)]
    df = spark.createDataFrame(rows, "period int, code string, industry string, global_rank int").cache()
    got, want, before = {}, {}, None
    for r in chained_top_k(df, c).orderBy("period", "candidate_position").collect():
        got.setdefault(r.period, []).append((r.candidate_position, r.code, r.selection_reason))
    for period in range(12):
        basket = constrained_top_k(df.where(F.col("period") == period), c, before, by=("period",)).orderBy("candidate_position").collect()
        want[period] = [(r.candidate_position, r.code, r.selection_reason) for r in basket]
        before = [r.code for r in basket]
    assert got == want
    most = max(r[0] for r in contenders(df, c).groupBy("period").count().select("count").collect())
    assert most <= max(4 * k, k * buffer + 2 * k)


@pytest.fixture(scope="module")
def prepared(spark):
    found = CandidateSelector(config()).prepare(panel(spark, SF))
    kept = found.frame.persist()
    yield type(found)(kept, found.feature_columns)
    kept.unpersist()


def _backtest(spark, prepared, periods, scorer, group):
    c = config()
    c.backtest.max_periods = periods
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = CandidateSelector(c, scorer).backtest_prepared(prepared)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        return found, jobs
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_the_periods(spark, prepared):
    few, a = _backtest(spark, prepared, 2, LinearScore(WEIGHTS), "few")
    many, b = _backtest(spark, prepared, 14, LinearScore(WEIGHTS), "many")
    assert (few.summary["periods"], many.summary["periods"]) == (2, 14)
    assert b <= a + 3


def test_fits_side_by_side_give_what_a_fixed_score_gives(spark, prepared):
    linear = LinearScore(WEIGHTS)
    rows = {}

    def fitted(train, score, columns, settings):
        rows[score.first()["date"].isoformat()] = train.count()
        return score.withColumn("model_score", linear.value()), FitDiagnostics(0, 0, 0, 0.0, 0.0, "x", 0)

    a, _ = _backtest(spark, prepared, 5, linear, "fixed")
    b, _ = _backtest(spark, prepared, 5, fitted, "fits")
    assert a.holdings.collect() == b.holdings.collect() and a.periods.collect() == b.periods.collect() and a.summary == b.summary
    # each fit had the window of its own date
    for r in a.periods.collect():
        day = r["date"].isoformat()
        assert fit_and_score(prepared, config(), day, linear).diagnostics.rows == rows[day]


def test_guards(spark, prepared):
    c = config()
    c.model.min_train_rows = 10**9
    with pytest.raises(ValueError, match="training rows before"):
        CandidateSelector(c, LinearScore(WEIGHTS)).backtest_prepared(prepared)
    days = day_counts(prepared.frame)
    assert [d.at for d in days] == list(range(len(days)))
    empty = days[100].date
    some = type(prepared)(prepared.frame.withColumn("eligible", F.col("eligible") & (F.col("date") != F.lit(empty).cast("date"))), prepared.feature_columns)
    c = config()
    c.backtest.rebalance_every_days, c.model.min_train_rows = 1, 1
    with pytest.raises(ValueError, match=f"nothing is eligible on {empty}"):
        CandidateSelector(c, LinearScore(WEIGHTS)).backtest_prepared(some)
