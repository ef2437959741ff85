"""A panel of suppliers by week, from the order tables: the engine's fixture.

Weeks without a shipment leave gaps, as suspensions do. The DuckDB text makes
the same panel; inputs aren't rounded, and sums of money are decimal, so that
both give the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AppConfig
from ..functions.windows import by_code
from ..sources.market import adjusted, valid_market_data, with_calendar

_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def config() -> AppConfig:
    """Settings that suit some hundred weeks of some ten to thousand suppliers."""
    c = AppConfig()
    c.universe.min_listing_days, c.universe.min_price, c.universe.min_avg_amount = 30, 2.0, 0.0
    c.features.min_feature_history = 20
    c.model.min_train_days, c.model.train_lookback_days, c.model.min_train_rows = 60, 120, 100
    c.model.n_estimators, c.model.num_leaves, c.model.min_child_samples = 5, 8, 20
    c.selection.top_k, c.selection.max_industry_fraction = 10, 0.3
    c.backtest.rebalance_every_days, c.backtest.max_periods = 20, None
    s = c.feature_screening
    s.min_screening_days, s.min_cross_sectional_stocks, s.min_abs_mean_ic, s.min_abs_ic_tstat = 10, 5, 0.0, 0.0
    s.min_feature_coverage = 0.2
    return c


def _units(x: Column, digits: int) -> tuple[Column, Column]:
    """Aggregates: the upper and lower half of the sum of x, each value rounded as
    SQL's cast to DECIMAL(18, digits) rounds it, in units of the last digit. Sums
    of longs; those of decimals cost several times as much."""
    units = (x.cast(f"decimal(18,{digits})") * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast("long")
    return F.sum(F.shiftright(units, 32)), F.sum(units.bitwiseAND(F.lit(2**32 - 1)))


def _of_units(high: str, low: str, digits: int) -> Column:
    """_units as the nearest double: by one division where the units are an exact double, else by decimals."""
    h, l, wide = F.col(high), F.col(low), "decimal(19,0)"  # noqa: E741
    exact = (h.cast(wide) * F.lit(2**32).cast("decimal(10,0)") + l.cast(wide)) * F.lit(f"1e-{digits}").cast(f"decimal({digits + 1},{digits})")
    small = (F.abs(h) < 2**19) & (l < 2**51)
    return F.when(small, (h * F.lit(2**32) + l) / float(10**digits)).otherwise(exact.cast("double"))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One exchange, of the lines by code, and one sort: the aggregation by (code,
    week), the supplier's place and the windows along a code all use them. There
    are about two lines a week, so combining them before the shuffle saves little
    and would sort them twice (first and last prices don't fit a hash aggregation)."""
    c = F.col
    lines = read(spark, sf_dir, "lineitem")
    date = F.date_sub(F.to_date("l_shipdate"), F.weekday("l_shipdate")).alias("date")
    code = lambda x: F.lpad(c(x).cast("string"), 6, "0").alias("code")
    line = lines.select(code("l_suppkey"), "l_suppkey", date, *_ORDER, "l_discount", "l_returnflag").repartition("code")
    line = with_calendar(line, lines.select(date)).withColumns({"px": c("l_extendedprice") / c("l_quantity"), "at": F.struct(*_ORDER)})
    share = lambda x: F.count_if(c("l_returnflag") == x)
    parts = ("amount high", "amount low", "discounted high", "discounted low")
    weeks = line.groupBy("code", "date_idx", "date", "l_suppkey").agg(
        F.min_by("px", "at").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "at").alias("close"),
        F.sum("l_quantity").alias("volume"), *(x.alias(n) for x, n in zip((*_units(c("l_extendedprice"), 2), *_units(c("l_quantity") * c("l_discount"), 4)), parts, strict=True)),
        F.count("*").alias("n"), share("R").alias("r"), share("A").alias("a"),
    )
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    place = supplier.join(nation, c("s_nationkey") == c("n_nationkey")).join(region, c("n_regionkey") == c("r_regionkey"))
    place = place.select(code("s_suppkey"), "s_suppkey", "s_acctbal", c("r_name").alias("industry"))
    # by the code alone, so that the lines' exchange serves the join as well; two suppliers share one only beyond six digits
    same = (weeks["code"] == place["code"]) & (c("l_suppkey").bitwiseXOR(c("s_suppkey")) == 0)
    df = weeks.join(place, same).select(
        "date", weeks["code"], "date_idx", "industry", "open", "high", "low", "close", "volume", _of_units(*parts[:2], 2).alias("amount"),
        F.lit(1.0).alias("adj_factor"), (c("s_acctbal") * 1000000.0).alias("market_cap"), (_of_units(*parts[2:], 4) / c("volume")).alias("turnover_rate"),
        (c("r") * 10 >= c("n") * 8).alias("is_st"), F.lit(False).alias("is_suspended"), (c("a") * 10 >= c("n") * 9).alias("is_limit_up"), F.lit(False).alias("is_limit_down"),
    )
    df = df.withColumns({"listing_days": F.row_number().over(by_code()).cast("double"), "has_valid_market_data": valid_market_data()})
    return adjusted(df)


SQL = """
lines AS (SELECT l_suppkey, cast(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS px, * EXCLUDE (l_suppkey) FROM lineitem),
weeks AS (SELECT l_suppkey, date,
    first(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS open, max(px) AS high, min(px) AS low,
    last(px ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS close, sum(l_quantity) AS volume,
    cast(sum(cast(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, cast(sum(cast(l_quantity * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS discounted,
    count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a
    FROM lines GROUP BY l_suppkey, date),
calendar AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS date_idx FROM (SELECT DISTINCT date FROM weeks)),
panel AS (SELECT date, date_idx, lpad(cast(l_suppkey AS VARCHAR), 6, '0') AS code, r_name AS industry, open, high, low, close, volume, amount,
    s_acctbal * 1000000.0 AS market_cap, discounted / volume AS turnover_rate, r * 10 >= n * 8 AS is_st, a * 10 >= n * 9 AS is_limit_up,
    cast(row_number() OVER (PARTITION BY l_suppkey ORDER BY date) AS DOUBLE) AS listing_days,
    open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AND amount >= 0 AS has_valid_market_data,
    open AS adj_open, high AS adj_high, low AS adj_low, close AS adj_close
    FROM weeks JOIN calendar USING (date) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
"""
