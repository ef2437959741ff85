from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from panelwright.sources.landed import LandedTable


def frame(spark, days, x, **more):
    df = spark.createDataFrame([(d, i, x) for d in days for i in range(3)], "trade_date string, i int, x string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def shown(df):
    return sorted(tuple(r) for r in df.collect())


def test_replaced_dates_ranges_and_columns(spark, tmp_path):
    t = LandedTable(spark, f"{tmp_path}/t")
    assert t.keys() == [] and t.scan().count() == 0
    days = [f"202501{d:02d}" for d in range(1, 11)]
    assert t.land(frame(spark, days, "a")) == days
    before = t.scan("20250103", "20250104")
    t.land(frame(spark, ["20250104", "20250112"], "b", note="new"))
    # who read before goes on with the rows of that time
    assert {r[2] for r in shown(before)} == {"a"}
    now = t.scan("20250103", "20250104")
    assert shown(now) == sorted([("20250103", i, "a", None) for i in range(3)] + [("20250104", i, "b", "new") for i in range(3)])
    # only the dates asked for are opened
    opened = {f.split("landed%20key=")[1].split("/")[0] for f in now.inputFiles()}
    assert opened == {"20250103", "20250104"}
    assert shown(t.scan(keys=["20250112", "20990101"])) == [("20250112", i, "b", "new") for i in range(3)]
    assert t.keys() == [*days, "20250112"]
    all_rows = shown(t.scan())
    assert t.vacuum() == 1 and shown(t.scan()) == all_rows and LandedTable(spark, f"{tmp_path}/t").keys() == [*days, "20250112"]


def test_refused_rows_leave_nothing_behind(spark, tmp_path):
    t = LandedTable(spark, f"{tmp_path}/t")
    t.land(frame(spark, ["20250101"], "a"))
    for odd in (None, "2025/01/02", "a b"):
        with pytest.raises(ValueError, match="can't be landed"):
            t.land(frame(spark, ["20250102"], "z").withColumn("trade_date", F.lit(odd).cast("string")))
    with pytest.raises(ValueError, match="another type"):
        t.land(frame(spark, ["20250102"], "z").withColumn("x", F.lit(1)))
    assert t.land(frame(spark, ["20250102"], "z").where("false")) == []
    assert t.keys() == ["20250101"] and shown(t.scan()) == [("20250101", i, "a") for i in range(3)]


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    days = [f"202502{d:02d}" for d in range(1, 7)]

    def land(day):
        LandedTable(spark, f"{tmp_path}/t").land(frame(spark, [day], day))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(land, days))
    t = LandedTable(spark, f"{tmp_path}/t")
    assert t.keys() == days and t.scan().count() == 18
