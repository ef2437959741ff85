"""What keeps the panel's queries within their limits as the tables grow."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions import windows as fw
from panelwright.operators import features as ft
from panelwright.plans import fixture, queries

DATA = "/root/testdata/sf0.001"


def test_lines_are_shuffled_and_sorted_once(spark):
    """All that runs along a code uses the one exchange of the lines."""
    plan = queries.feature_catalogue(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(code") == 2  # the lines, and the suppliers
    assert "Exchange hashpartitioning(l_suppkey" not in plan


def test_dates_are_dealt_to_tasks_in_turn(spark):
    frame = ft.build_features(fixture.panel(spark, DATA), fixture.config()).frame
    dates = frame.select("date", F.spark_partition_id().alias("task")).distinct().groupBy("task").count()
    most, n = dates.agg(F.max("count"), F.sum("count")).first()
    assert most == -(-n // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def test_training_dates_are_filtered_before_they_are_ranked(spark):
    frame = ft.build_features(fixture.panel(spark, DATA), fixture.config()).frame
    plan = frame.where("date_idx BETWEEN 3 AND 9").select("code", "target_rank")._jdf.queryExecution().optimizedPlan().toString()
    dealt, held = (next(i for i, line in enumerate(plan.splitlines()) if x in line) for x in ("Repartition", "<= 9"))
    assert held > dealt  # further down the plan


@pytest.mark.parametrize("digits", [2, 4])
def test_sums_in_units_are_those_of_decimals(spark, digits):
    values = [[0.005, 1.015, -2.675, 3.1], [9.0e13, 9.0e13 + 0.25, 3e12], [-9.0e13, -1.25, 1e-4], [None, 7.5], [None]]
    df = spark.createDataFrame([(i, x) for i, g in enumerate(values) for x in g for _ in range(200 if abs(x or 0) > 1e13 else 1)], "g int, x double")
    high, low = fixture._units(F.col("x"), digits)
    found = df.groupBy("g").agg(high.alias("h"), low.alias("l"), F.sum(F.col("x").cast(f"decimal(18,{digits})")).cast("double").alias("want"))
    rows = found.select("want", fixture._of_units("h", "l", digits).alias("got")).collect()
    assert len(rows) == 5 and all(r["got"] == r["want"] for r in rows)


@pytest.mark.parametrize("query", [queries.vendor_standardise, queries.vendor_repeated_masters])
def test_vendor_frames_are_read_from_one_landed_panel(spark, query):
    assert not [f for f in query(spark, DATA).inputFiles() if "lineitem" in f]


def test_rolling_windows_are_not_gone_over_anew_for_each_row(spark):
    """No frame of a fixed number of rows is left in the catalogue or the language."""
    plan = queries.feature_catalogue(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "specifiedwindowframe(RowFrame, -19" not in plan and "specifiedwindowframe(RowFrame, -59" not in plan
    plan = queries.expressions(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(f"specifiedwindowframe(RowFrame, -{n - 1}, currentrow$()" in plan for n in (5, 10, 20))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 20, 60])
def test_rolling_windows_by_halves_are_those_of_frames(spark, n):
    rng = random.Random(n)
    rows = [(c, i, None if rng.random() < 0.01 else rng.choice([0.1, 2.5, 1e6, -3.0]) if c != "same" else 0.1) for c in ("a", "b", "same", "short") for i in range(5 if c == "short" else 150) if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "code string, date_idx int, x double")
    kinds = ("mean", "std", "min", "max", "sum")
    made = fw.with_rolling(df.withColumns({f"{k} frame": fw.rolling(F.col("x"), n, k) for k in kinds}), {k: ("x", n, k) for k in kinds}).collect()
    assert len(made) == len(rows)
    for r in made:
        for k in kinds:
            assert (r[k] is None) == (r[f"{k} frame"] is None) and (r[k] is None or math.isclose(r[k], r[f"{k} frame"], rel_tol=1e-9, abs_tol=1e-9)), (k, r)
        assert r["code"] != "same" or not r["std"]


def test_exponential_means_take_no_other_columns_through_python(spark):
    df = spark.range(6000).select((F.col("id") % 7).cast("string").alias("code"), (F.col("id") / 7).cast("int").alias("date_idx"), F.when(F.col("id") % 5 != 0, F.rand(1) * 10).alias("x"), F.repeat(F.lit("wide"), 9).alias("text"))
    made = fw.with_ema(df, {"e": ("x", 3), "f": ("x", 9)})
    got = made.toPandas().sort_values(["code", "date_idx"])
    for name, n in (("e", 3), ("f", 9)):
        want = got.groupby("code")["x"].transform(lambda s: s.ewm(span=n, min_periods=n, adjust=False).mean())  # noqa: B023
        np.testing.assert_allclose(got[name].astype(float), want, rtol=1e-12)
    assert made.where("e IS NULL").count() == int(got["e"].isna().sum()) and made.where("isnan(e)").count() == 0
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "ArrowEvalPython" in plan


def test_training_dates_are_counted_without_ranks(spark):
    """A row has a rank where it has a forward return."""
    plan = queries.training_window(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" not in plan
    frame = ft.build_features(fixture.panel(spark, DATA), fixture.config()).frame
    assert frame.where(ft.labelled(frame) != F.col("target_rank").isNotNull()).count() == 0
