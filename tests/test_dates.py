import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelwright.sources.market import ISO, date_form, date_in, standardise


def column(spark, *cells):
    return spark.createDataFrame([(c,) for c in cells], "d string")


@pytest.mark.parametrize(
    ("cells", "form", "first"),
    [
        (("2024-01-02", "20240103", None, "2024-02-29 10:00:00"), ISO, (2024, 1, 2)),
        (("2024/01/02", "2024/1/3 09:30"), "yyyy/M/d", (2024, 1, 2)),
        (("2024-1-2", "2024-01-13"), "yyyy-M-d", (2024, 1, 2)),
        (("01/02/2024", "13/02/2024", None), "d/M/yyyy", (2024, 2, 1)),
        (("01/02/2024", "02/13/2024"), "M/d/yyyy", (2024, 1, 2)),
        (("1.2.2024", "01.02.2024"), "d.M.yyyy", (2024, 2, 1)),
        (("3 Feb 2024", "13 Mar 2024"), "d MMM yyyy", (2024, 2, 3)),
        # day and month first agree on each cell
        (("02/02/2024", "3/3/2024"), "d/M/yyyy", (2024, 2, 2)),
        ((None, None), ISO, None),
        ((), ISO, None),
    ],
)
def test_the_form_that_reads_all(spark, cells, form, first):
    df = column(spark, *cells)
    assert date_form(df, "d") == form
    if first:
        got = [r[0] for r in df.select(date_in(F.col("d"), form)).collect()]
        assert got[0] == dt.date(*first) and [x is None for x in got] == [c is None for c in cells]


@pytest.mark.parametrize(
    ("cells", "error"),
    [
        (("01/02/2024", "03/04/2024"), "d/M/yyyy or M/d/yyyy"),
        (("13/02/2024", "02/13/2024"), "can't be read"),
        (("2024/01/02", "2024-01-02", "2024/01/04"), r"'2024-01-02'.*the others are yyyy/M/d"),
        (("2023-02-29", "2023-02-28"), "'2023-02-29'"),
        (("01/02/24",), "can't be read"),
        (("",), "can't be read"),
    ],
)
def test_mixed_and_doubtful_columns_are_refused(spark, cells, error):
    with pytest.raises(ValueError, match=error):
        date_form(column(spark, *cells), "d")


def test_a_market_frame_in_another_form(spark):
    price = dict.fromkeys(("open", "high", "low", "close", "volume", "amount"), "1")
    rows = [{"date": d, "code": "7", **price} for d in ("30/01/2024", "02/02/2024")]
    df = spark.createDataFrame(rows)
    got = {(str(r.date), r.date_idx) for r in standardise(df).collect()}
    assert got == {("2024-01-30", 0), ("2024-02-02", 1)}
    doubtful = df.withColumn("date", F.when(F.col("date") == "30/01/2024", "03/01/2024").otherwise("04/02/2024"))
    with pytest.raises(ValueError, match="name the form"):
        standardise(doubtful)
    assert {str(r.date) for r in standardise(doubtful, date_format="d/M/yyyy").collect()} == {"2024-01-03", "2024-02-04"}
    with pytest.raises(ValueError, match="can't be read"):
        standardise(df.withColumn("date", F.lit(None).cast("string")))
