import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.config import AppConfig
from panelwright.functions import windows as fw
from panelwright.operators import features as ft
from panelwright.operators.expressions import FeatureDefinition, compile_features
from panelwright.sources import market as mk
from panelwright.sources.demo import demo_panel


def small():
    c = AppConfig()
    c.universe.min_listing_days, c.universe.min_avg_amount, c.features.min_feature_history = 60, 0.0, 60
    return c


@pytest.fixture(scope="module")
def demo(spark):
    raw = demo_panel(20, 300, 11)
    return raw, mk.standardise(spark.createDataFrame(raw)).persist()


def test_windows_match_pandas(spark):
    rng = np.random.default_rng(1)
    rows = []
    for code in ("a", "b", "c"):
        for i in sorted(rng.choice(60, 45, replace=False).tolist()):
            rows.append((code, i, None if rng.random() < 0.1 else float(rng.integers(0, 5))))
    df = spark.createDataFrame(rows, "code string, date_idx int, x double")
    c = F.col("x")
    made = fw.with_ema(df.withColumns({"mean": fw.rolling(c, 4, "mean"), "std": fw.rolling(c, 4, "std"), "min": fw.rolling(c, 4, "min"), "sum": fw.rolling(c, 4, "sum"), "lag": fw.lag(c, 2), "g": fw.guarded_growth(c, 2), "z": fw.zscore(c, 4)}), {"ema": ("x", 3)})
    got = made.toPandas().sort_values(["code", "date_idx"]).reset_index(drop=True)
    p = pd.DataFrame(rows, columns=["code", "date_idx", "x"]).sort_values(["code", "date_idx"]).reset_index(drop=True)
    by = p.groupby("code")["x"]
    roll = lambda f: by.transform(lambda s: f(s.rolling(4, min_periods=4)))
    std = roll(lambda r: r.std(ddof=0))
    want = {
        "mean": roll(lambda r: r.mean()), "std": std, "min": roll(lambda r: r.min()), "sum": roll(lambda r: r.sum()), "lag": by.shift(2),
        "g": p.x / by.shift(2).where(by.shift(2).abs() > 1e-12) - 1, "z": (p.x - roll(lambda r: r.mean())) / std.where(std > 1e-9),
        "ema": by.transform(lambda s: s.ewm(span=3, min_periods=3, adjust=False).mean()),
    }
    for k, v in want.items():
        np.testing.assert_allclose(got[k].astype(float), v, rtol=1e-9, atol=1e-9, err_msg=k)


def test_ranks_with_ties_and_nulls(spark):
    rng = random.Random(2)
    rows = [(d, rng.choice([None, -0.0, 0.0, 1.0, 2.0, 3.5])) for d in "xyz" for _ in range(30)]
    got = spark.createDataFrame(rows, "date string, x double").withColumn("r", fw.percentile_rank(F.col("x"), "date")).toPandas()
    want = got.groupby("date")["x"].rank(method="average", pct=True) - 0.5
    np.testing.assert_array_equal(got["r"], want)


def test_labels_skip_gaps(spark):
    rows = [("a", i, 10.0 + i) for i in (0, 1, 2, 3, 5, 6)] + [("b", i, 5.0) for i in range(7)]
    df = spark.createDataFrame(rows, "code string, date_idx int, adj_open double").withColumn("date", F.col("date_idx"))
    got = {(r.code, r.date_idx): r.forward_return for r in ft.with_forward_return(df, 2).collect()}
    assert got["a", 0] == 13 / 11 - 1 and got["a", 3] is None and got["a", 1] is None and got["a", 2] == 15 / 13 - 1 and got["b", 4] is None and got["b", 3] == 0


def test_ingest_rules(spark, tmp_path):
    path = tmp_path / "m.csv"
    head = "date,code,open,high,low,close,volume,amount,is_st,adj_factor,industry,extra\n"
    path.write_text(head + "20240102,1,1,2,1,2,10,20,yes,0,,e\n2024-01-03,000001,x,2,1,2,10,20,否,2,NA,f\n2024-01-03, 600000.SH ,1,2,1,2,10,-1,,NaN,bank,g\n", encoding="utf-8")
    rows = mk.load_market_data(spark, str(path), AppConfig()).orderBy("code", "date").collect()
    assert [(r.code, str(r.date), r.is_st, r.adj_factor, r.industry, r.has_valid_market_data, r.listing_days, r.extra) for r in rows] == [
        ("000001", "2024-01-02", True, 1.0, "UNKNOWN", True, 1.0, "e"), ("000001", "2024-01-03", False, 2.0, "UNKNOWN", False, 2.0, "f"), ("600000.SH", "2024-01-03", False, 1.0, "bank", False, 1.0, "g"),
    ]
    assert rows[1].open is None and rows[1].adj_close == 4.0 and rows[2].date_idx == 1
    for body, words in (
        ("2024-01-02,1,1,2,1,2,10,20,maybe,1,a,e\n", "neither true"), ("x,1,1,2,1,2,10,20,1,1,a,e\n", "dates"), ("2024-01-02,,1,2,1,2,10,20,1,1,a,e\n", "without a code"),
        ("2024-01-02,1,1,2,1,2,10,20,1,1,a,e\n2024-01-02,000001,1,2,1,2,10,20,1,1,a,e\n", "duplicate"),
    ):
        path.write_text(head + body)
        with pytest.raises(ValueError, match=words):
            mk.load_market_data(spark, str(path), AppConfig())
    path.write_text("date,code\n2024-01-02,1\n")
    with pytest.raises(ValueError, match="missing columns"):
        mk.load_market_data(spark, str(path), AppConfig())
    with pytest.raises(FileNotFoundError):
        mk.load_market_data(spark, str(tmp_path / "none.csv"), AppConfig())


def test_features_see_no_later_row(spark, demo):
    raw, panel = demo
    made = [FeatureDefinition("ai_z_one", "ts_zscore(safe_div(amount, volume + 1), 20)", "A test feature."), FeatureDefinition("ai_e_two", "ema(return_1, 5)", "A test feature.")]
    whole = ft.build_features(panel, small(), made)
    days = sorted(raw["date"].unique())
    cut = ft.build_features(mk.standardise(spark.createDataFrame(raw[raw["date"] <= days[-30]])), small(), made)
    assert whole.feature_columns == cut.feature_columns and len(whole.feature_columns) == 22
    one, two = (x.frame.where(F.col("date") == F.lit(days[-30]).cast("date")).select("code", "eligible", *whole.feature_columns).orderBy("code").toPandas() for x in (whole, cut))
    pd.testing.assert_frame_equal(one, two)
    assert one["eligible"].any() and one[whole.feature_columns].notna().all(axis=None)


def test_nested_windows_are_shared():
    compiled = compile_features({"x": "lag(rolling_mean(volume, 5), 2) + rolling_mean(volume, 5)", "y": "rolling_mean(volume, 5) * 2"}, {"volume"})
    assert [len(level) for level in compiled.levels] == [1, 1]
