"""A query for each operator family over the fixture panel, with DuckDB's SQL.

Derived numbers are rounded once, in the result; keys are never rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fs
from ..functions import windows as fw
from ..operators import boosting as bo
from ..operators import features as ft
from ..operators import metrics as mt
from ..operators import model as md
from ..operators import selection as sl
from ..operators.backtest import CandidateSelector
from ..operators.backtest import score_dates as backtest_dates
from ..operators.expressions import FeatureDefinition, compile_features
from ..operators.screening import coverage, screen_feature_definitions, screening_window
from ..sources import market as mk
from ..sources import vendor as vd
from ..sources.landed import LandedTable
from .fixture import SQL, config, panel, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _rounded(x: Column | str, digits: int) -> Column:
    """Half up in plain double arithmetic: round() differs between engines there."""
    x = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def _half_up(sql: str) -> str:
    """sql with each round(x, digits) written as _rounded() computes it."""
    while (at := sql.find("round(")) >= 0:
        depth, i = 1, at + 6
        comma = i
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            if depth == 1 and sql[i] == ",":
                comma = i
            i += 1
        scale = f"1e{sql[comma + 1 : i - 1].strip()}"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {scale} + 0.5) / {scale}){sql[i:]}"
    return sql


def _query(sql: str | None = None, **more: str) -> Callable[[Query], Query]:
    def of(f: Query) -> Query:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = _half_up(f"WITH {SQL}, {sql}" if more.get("panel", "yes") == "yes" else sql)
        return f

    return of


def _out(df: DataFrame, *keys: str, digits: int = 6, **columns: Column) -> DataFrame:
    return df.select(*keys, *(_rounded(c, digits).alias(k) for k, c in columns.items()))


def _w(n: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY date_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_BY = "OVER (PARTITION BY code ORDER BY date_idx)"
_KEY = ("date", "code")
_DAY = ("date", "date_idx")


def _roll(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN {f}({x}) {_w(n)} END"


def _rank(x: str, by: str = "date") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + count({x}) OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST"
        f" RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 / count({x}) OVER (PARTITION BY {by}) - 0.5 END"
    )


# --- panel and scans ---


@_query("x AS (SELECT date, date_idx, code, industry, open, high, low, close, volume, amount, market_cap, round(turnover_rate, 6) AS turnover_rate, listing_days, is_st, is_limit_up, has_valid_market_data FROM panel) SELECT * FROM x")
def panel_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.select("date", "date_idx", "code", "industry", "open", "high", "low", "close", "volume", "amount", "market_cap", _rounded("turnover_rate", 6).alias("turnover_rate"), "listing_days", "is_st", "is_limit_up", "has_valid_market_data")


# --- windows along an entity ---

_RETURN = f"adj_close / nullif(lag(adj_close) {_BY}, 0) - 1"


@_query(f"x AS (SELECT date, code, round({_RETURN}, 6) AS return_1 FROM panel) SELECT * FROM x")
def pct_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, return_1=fw.growth(F.col("adj_close")))


@_query("x AS (SELECT date, code, " + ", ".join(f"round(adj_close / nullif(lag(adj_close, {n}) {_BY}, 0) - 1, 6) AS momentum_{n}" for n in (5, 10, 20, 60)) + " FROM panel) SELECT * FROM x")
def lag_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, **{f"momentum_{n}": fw.growth(F.col("adj_close"), n) for n in (5, 10, 20, 60)})


@_query(f"x AS (SELECT date, code, round({_roll('avg', 'amount', 20)}, 4) AS mean_20 FROM panel) SELECT * FROM x")
def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, digits=4, mean_20=fw.rolling(F.col("amount"), 20, "mean"))


@_query(f"r AS (SELECT *, {_RETURN} AS ret FROM panel), x AS (SELECT date, code, round({_roll('stddev_pop', 'ret', 20)}, 6) AS vol_20, round({_roll('stddev_pop', 'ret', 60)}, 6) AS vol_60 FROM r) SELECT * FROM x")
def rolling_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("ret", fw.growth(F.col("adj_close")))
    return _out(df, *_KEY, vol_20=fw.rolling(F.col("ret"), 20, "std"), vol_60=fw.rolling(F.col("ret"), 60, "std"))


@_query(f"x AS (SELECT date, code, round({_roll('min', 'adj_close', 20)}, 6) AS low_20, round({_roll('max', 'adj_close', 20)}, 6) AS high_20 FROM panel) SELECT * FROM x")
def rolling_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, low_20=fw.rolling(F.col("adj_close"), 20, "min"), high_20=fw.rolling(F.col("adj_close"), 20, "max"))


@_query(f"x AS (SELECT date, code, round({_roll('sum', 'volume', 10)}, 6) AS sum_10 FROM panel) SELECT * FROM x")
def rolling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, sum_10=fw.rolling(F.col("volume"), 10, "sum"))


@_query(f"x AS (SELECT date, code, round(adj_close - lag(adj_close, 5) {_BY}, 6) AS delta_5 FROM panel) SELECT * FROM x")
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, delta_5=fw.delta(F.col("adj_close"), 5))


@_query(f"z AS (SELECT *, {_roll('avg', 'adj_close', 20)} AS m, {_roll('stddev_pop', 'adj_close', 20)} AS s FROM panel), x AS (SELECT date, code, round(CASE WHEN s > 1e-12 THEN (adj_close - m) / s END, 6) AS z_20 FROM z) SELECT * FROM x")
def ts_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, z_20=fw.zscore(F.col("adj_close"), 20))


_EMA = """n AS (SELECT code, date, adj_close AS v, row_number() OVER (PARTITION BY code ORDER BY date_idx) AS i FROM panel),
    e AS (SELECT code, date, i, v AS y FROM n WHERE i = 1 UNION ALL SELECT n.code, n.date, n.i, e.y * (1 - 2.0 / 6) + n.v * (2.0 / 6) FROM e JOIN n ON n.code = e.code AND n.i = e.i + 1)
    SELECT date, code, round(CASE WHEN i >= 5 THEN y END, 6) AS ema_5 FROM e"""


@_query(_EMA)
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    lean = panel(spark, sf_dir).select("date", "code", "date_idx", "adj_close")
    return _out(fw.with_ema(lean, {"e": ("adj_close", 5)}), *_KEY, ema_5=F.col("e"))


ORACLES["ema"] = ORACLES["ema"].replace("WITH ", "WITH RECURSIVE ", 1)

# --- scalars ---


@_query("x AS (SELECT date, code, round(CASE WHEN abs(market_cap) > 1e-12 THEN amount / market_cap END, 6) AS q, round(CASE WHEN abs(volume - 30) > 1e-12 THEN amount / (volume - 30) END, 4) AS q2 FROM panel) SELECT * FROM x")
def safe_div(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return p.select(*_KEY, _rounded(fs.safe_div(F.col("amount"), F.col("market_cap")), 6).alias("q"), _rounded(fs.safe_div(F.col("amount"), F.col("volume") - 30), 4).alias("q2"))


@_query("x AS (SELECT date, code, round(sign(market_cap) * ln(1 + abs(market_cap)), 6) AS s FROM panel) SELECT * FROM x")
def signed_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(panel(spark, sf_dir), *_KEY, s=fs.signed_log1p(F.col("market_cap")))


@_query(f"r AS (SELECT *, {_RETURN} AS ret FROM panel), x AS (SELECT date, code, round(CASE WHEN ret IS NOT NULL THEN greatest(-0.1, least(ret, 0.1)) END, 6) AS c FROM r) SELECT * FROM x")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("ret", fw.growth(F.col("adj_close")))
    return _out(df, *_KEY, c=fs.clip(F.col("ret"), -0.1, 0.1))


@_query(f"r AS (SELECT *, lag(adj_close) {_BY} AS prev FROM panel), x AS (SELECT date, code, CASE WHEN prev IS NOT NULL THEN round(least(prev, adj_close), 6) END AS low, CASE WHEN prev IS NOT NULL THEN round(greatest(prev, adj_close), 6) END AS high FROM r) SELECT * FROM x")
def minmax_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir).withColumn("prev", fw.lag(F.col("adj_close"), 1))
    return _out(df, *_KEY, low=fs.minimum(F.col("prev"), F.col("adj_close")), high=fs.maximum(F.col("prev"), F.col("adj_close")))


# --- the catalogue, ranks and labels ---

_RAW_SQL = f"""
r0 AS (SELECT *, lag(adj_close) {_BY} AS prev, {_RETURN} AS return_1 FROM panel),
r1 AS (SELECT *, abs(return_1) / greatest(amount, 1) AS illiq, {', '.join(f'adj_close / nullif(lag(adj_close, {n}) {_BY}, 0) - 1 AS momentum_{n}' for n in (5, 10, 20, 60))},
    {_roll('stddev_pop', 'return_1', 20)} AS volatility_20, {_roll('stddev_pop', 'return_1', 60)} AS volatility_60, {_roll('avg', 'amount', 20)} AS avg_amount_liquidity,
    {_roll('avg', 'volume', 20)} AS mean_volume, {_roll('min', 'adj_close', 20)} AS low_20, {_roll('max', 'adj_close', 20)} AS high_20 FROM r0),
raw AS (SELECT *, adj_open / prev - 1 AS overnight_gap, adj_close / adj_open - 1 AS intraday_return, (adj_high - adj_low) / (abs(prev) + 1e-12) AS range_pct,
    amount / (avg_amount_liquidity + 1e-12) AS amount_ratio_20, volume / (mean_volume + 1e-12) AS volume_ratio_20,
    (adj_close - low_20) / (high_20 - low_20 + 1e-12) AS price_position_20, ({_roll('avg', 'illiq', 20)}) * 1e8 AS amihud_20,
    (adj_open / prev - 1) / (volatility_20 + 1e-12) AS gap_volnorm_20, momentum_5 / (volatility_20 * sqrt(5.0::DOUBLE) + 1e-12) AS momentum_5_volnorm_20,
    (momentum_5 - momentum_20 * 0.25) / (volatility_20 * sqrt(5.0::DOUBLE) + 1e-12) AS trend_5_20, volatility_20 / (volatility_60 + 1e-12) AS volatility_regime,
    ln(1 + greatest(market_cap, 0)) AS log_market_cap FROM r1)"""
_RAW = ft.raw_feature_names(config())


@_query(f"{_RAW_SQL}, x AS (SELECT date, code, {', '.join(f'round({c}, 5) AS {c}' for c in _RAW)} FROM raw) SELECT * FROM x")
def feature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ft.raw_features(panel(spark, sf_dir), config()), *_KEY, digits=5, **{c: F.col(c) for c in _RAW})


_RANKED = ("volume", "market_cap", "listing_days", "amount")


@_query(f"x AS (SELECT date, code, {', '.join(f'round({_rank(c)}, 6) AS {c}_cs' for c in _RANKED)} FROM panel) SELECT * FROM x")
def cs_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fw.dealt_by_date(panel(spark, sf_dir))
    return _out(df, *_KEY, **{f"{c}_cs": fw.percentile_rank(F.col(c), *_DAY) for c in _RANKED})


def _forward_sql(horizon: int) -> str:
    at = lambda k: f"max(adj_open) OVER (PARTITION BY code ORDER BY date_idx RANGE BETWEEN {k} FOLLOWING AND {k} FOLLOWING)"
    return f"{at(horizon + 1)} / nullif({at(1)}, 0) - 1"


_LABEL_SQL = f"f AS (SELECT *, {_forward_sql(5)} AS forward_return FROM {{source}}), g AS (SELECT *, forward_return - avg(forward_return) OVER (PARTITION BY date) AS target_excess_return FROM f), labelled AS (SELECT *, {_rank('target_excess_return')} AS target_rank FROM g)"


@_query(f"x AS (SELECT date, code, round({_forward_sql(5)}, 6) AS forward_return FROM panel) SELECT * FROM x")
def forward_label_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(ft.with_forward_return(panel(spark, sf_dir), 5), *_KEY, forward_return=F.col("forward_return"))


@_query(f"{_LABEL_SQL.format(source='panel')}, x AS (SELECT date, code, round(target_excess_return, 6) AS target_excess_return, round(target_rank, 6) AS target_rank FROM labelled) SELECT * FROM x")
def target_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.with_targets(fw.dealt_by_date(ft.with_forward_return(panel(spark, sf_dir), 5)))
    return _out(df, *_KEY, target_excess_return=F.col("target_excess_return"), target_rank=F.col("target_rank"))


_READY = " + ".join(f"({c} IS NOT NULL)::INT" for c in _RAW)
_ELIGIBLE_SQL = f"ready AS (SELECT *, listing_days >= 20 AND ({_READY}) / {len(_RAW)} >= 0.6 AS feature_ready FROM {{source}}), eligible AS (SELECT *, coalesce(has_valid_market_data AND feature_ready AND listing_days >= 30 AND close >= 2 AND avg_amount_liquidity >= 0 AND NOT is_st AND NOT is_limit_up, false) AS eligible FROM ready)"


@_query(f"{_RAW_SQL}, {_ELIGIBLE_SQL.format(source='raw')}, x AS (SELECT date, code, feature_ready, eligible FROM eligible) SELECT * FROM x")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ft.build_features(panel(spark, sf_dir), config()).frame.select(*_KEY, "feature_ready", "eligible")


@_query(f"{_RAW_SQL}, {_LABEL_SQL.format(source='raw')}, {_ELIGIBLE_SQL.format(source='labelled')}, e AS (SELECT max(date_idx) - 6 AS last FROM panel) SELECT date, count(*) AS n FROM eligible, e WHERE eligible AND target_rank IS NOT NULL AND date_idx BETWEEN last - 119 AND last GROUP BY date")
def training_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by date that a model of the last date may be trained on."""
    window = md.training_window(ft.build_features(panel(spark, sf_dir), config()).frame, config())
    return window.rows.groupBy("date").agg(F.count("*").alias("n"))


@_query("x AS (SELECT date, date_idx FROM calendar, (SELECT count(*) AS n FROM calendar) WHERE date_idx >= 66 AND date_idx < n - 6 AND (date_idx - 66) % 20 = 0) SELECT * FROM x")
def score_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backtest_dates(panel(spark, sf_dir), config())
    return spark.createDataFrame(found, "date string, date_idx int").select(F.col("date").cast("date").alias("date"), "date_idx")


# --- ingest rules ---


@_query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN true WHEN event_id % 7 = 0 THEN true ELSE false END, false) AS flag FROM events", panel="no")
def bool_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    token = F.when(i % 5 == 0, None).when(i % 3 == 0, " YES ").when(i % 7 == 0, "是").when(i % 2 == 0, "n").otherwise("")
    return read(spark, sf_dir, "events").select("event_id", mk.flag(token).alias("flag"))


@_query("SELECT c_custkey, CASE WHEN length(cast(c_custkey AS VARCHAR)) <= 6 THEN lpad(cast(c_custkey AS VARCHAR), 6, '0') ELSE cast(c_custkey AS VARCHAR) END AS code, c_name AS other FROM customer", panel="no")
def code_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))
    return read(spark, sf_dir, "customer").select("c_custkey", mk.normal_code(key).alias("code"), mk.normal_code(F.col("c_name")).alias("other"))


@_query("SELECT o_orderkey, cast(o_orderdate AS DATE) AS d1, cast(o_orderdate AS DATE) AS d2, cast(NULL AS DATE) AS d3 FROM orders", panel="no")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", mk.parsed_date(F.date_format(d, "yyyy-MM-dd")).alias("d1"), mk.parsed_date(F.date_format(d, "yyyyMMdd")).alias("d2"), mk.parsed_date(F.lit("no date")).alias("d3")
    )


@_query(
    "SELECT o_orderkey, cast(o_orderdate AS DATE) AS slashes, cast(o_orderdate AS DATE) AS day_first, cast(o_orderdate AS DATE) AS month_first, cast(o_orderdate AS DATE) AS short, cast(o_orderdate AS DATE) AS compact,"
    " 'yyyy/M/d,d/M/yyyy,M/d/yyyy,yyyy-M-d,yyyy-MM-dd or yyyyMMdd' AS forms FROM orders", panel="no"
)
def date_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in five forms, each column read by the form found for it."""
    patterns = {"slashes": "yyyy/MM/dd HH:mm:ss", "day_first": "dd/MM/yyyy", "month_first": "M/d/yyyy", "short": "yyyy-M-d", "compact": "yyyyMMdd"}
    rows = read(spark, sf_dir, "orders").select("o_orderkey", *(F.date_format("o_orderdate", p).alias(c) for c, p in patterns.items()))
    forms = {c: mk.date_form(rows, c) for c in patterns}
    return rows.select("o_orderkey", *(mk.date_in(F.col(c), form).alias(c) for c, form in forms.items()), F.lit(",".join(forms.values())).alias("forms"))


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", panel="no")
def dup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mk.repeated_keys(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@_query("x AS (SELECT max(date) AS date, max(date_idx) AS date_idx FROM panel WHERE date <= DATE '1998-07-01') SELECT * FROM x")
def asof_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sl.as_of_index(panel(spark, sf_dir), "1998-07-01")
    return spark.createDataFrame([found], "date string, date_idx int").select(F.col("date").cast("date").alias("date"), "date_idx")


# --- joins of the vendor's frames ---

# Periods of all orders, for codes c0 to c49; codes c50 to c59 have none.
_PERIODS_SQL = """spans AS (SELECT 'c' || (o_custkey % 50) AS ts_code, CASE WHEN o_orderkey % 3 = 0 THEN '*ST x' ELSE 'plain' END AS name, cast(o_orderdate AS DATE) AS a,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE cast(o_orderdate AS DATE) + 40 END AS z FROM orders)"""


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    return o.select(
        F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("ts_code"),
        F.when(F.col("o_orderkey") % 3 == 0, "*ST x").otherwise("plain").alias("name"),
        F.date_format(day, "yyyyMMdd").alias("start_date"),
        F.when(F.col("o_orderkey") % 5 != 0, F.date_format(F.date_add(day, 40), "yyyyMMdd")).alias("end_date"),
    )


@_query(
    f"{_PERIODS_SQL}, m AS (SELECT DISTINCT 'c' || (l_suppkey % 60) AS ts_code, cast(l_shipdate AS DATE) AS date FROM lineitem),"
    " x AS (SELECT ts_code, date, CASE WHEN ts_code IN (SELECT ts_code FROM spans) THEN EXISTS (SELECT 1 FROM spans s WHERE s.ts_code = m.ts_code AND name LIKE '%ST%' AND m.date >= a AND (z IS NULL OR m.date <= z))"
    " ELSE ts_code IN ('c55', 'c56') END AS is_st FROM m) SELECT * FROM x"
)
def interval_st(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("c"), (F.col("l_suppkey") % 60).cast("string")).alias("ts_code"), F.to_date("l_shipdate").alias("date")).distinct()
    stocks = spark.range(60).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("ts_code"), F.when(F.col("id").isin(55, 56), "st y").otherwise("z").alias("name"))
    return vd.with_st_flags(market, stocks, _periods(spark, sf_dir)).select("ts_code", "date", "is_st")


def _vendor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as a vendor's tables are: landed, so that the frames taken from it
    read it instead of making it once each."""
    p = panel(spark, sf_dir).withColumns({"ts_code": F.col("code"), "trade_date": F.date_format("date", "yyyyMMdd")})
    at = _shared_path(spark, "vendor")
    p.select("ts_code", "trade_date", "date_idx", "industry", "open", "high", "low", "close", "volume", "amount", "turnover_rate", "market_cap").write.parquet(at)
    return spark.read.parquet(at)


@_query(
    "k AS (SELECT code AS ts_code, strftime(date, '%Y%m%d') AS trade_date, * FROM panel), x AS (SELECT ts_code, trade_date, volume * 100.0 AS volume, amount * 1000.0 AS amount,"
    " CASE WHEN date_idx % 2 = 0 THEN market_cap * 10000.0 END AS market_cap, CASE WHEN date_idx % 2 = 0 THEN round(turnover_rate / 100.0, 8) END AS turnover_rate,"
    " date_idx % 2 = 0 AND date_idx % 3 = 0 AS is_limit_up, CASE WHEN cast(ts_code AS INT) % 7 = 0 THEN 'UNKNOWN' ELSE industry END AS industry, datediff('day', DATE '1990-01-01', date) + 1.0::DOUBLE AS listing_days FROM k) SELECT * FROM x"
)
def vendor_standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins one to one, the dimension, units, limits and listing days."""
    p = _vendor_panel(spark, sf_dir)
    daily = p.select("ts_code", "trade_date", "open", "high", "low", "close", F.col("volume").alias("vol"), "amount")
    basic = p.where("date_idx % 2 = 0").select("ts_code", "trade_date", "turnover_rate", F.col("market_cap").alias("total_mv"), F.when(F.col("date_idx") % 3 == 0, 2).otherwise(0).alias("limit_status"))
    adj = p.select("ts_code", "trade_date", F.lit(1.0).alias("adj_factor"))
    stocks = p.groupBy("ts_code").agg(F.first("industry").alias("industry")).where(F.col("ts_code").cast("int") % 7 != 0)
    stocks = stocks.unionByName(p.select("ts_code").distinct().where(F.col("ts_code").cast("int") % 7 == 0).withColumn("industry", F.lit(""))).withColumn("list_date", F.lit("19900101"))
    out = vd.standard_market_data(daily, basic, adj, stocks)
    return out.select("ts_code", F.date_format("date", "yyyyMMdd").alias("trade_date"), "volume", "amount", "market_cap", _rounded("turnover_rate", 8).alias("turnover_rate"), "is_limit_up", "industry", "listing_days")


@_query(
    "k AS (SELECT code AS ts_code, date, date_idx, code FROM panel), x AS (SELECT ts_code, strftime(date, '%Y%m%d') AS trade_date, 'industry ' || (cast(ts_code AS INT) % 5) AS industry,"
    " cast(ts_code AS INT) % 3 = 0 AS is_st, CASE WHEN cast(ts_code AS INT) % 4 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS adj_factor FROM k WHERE date_idx % 11 <> 0) SELECT * FROM x"
)
def vendor_repeated_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code's first row of the dimension counts, its name and its industry;
    missing factors are 1; rows without a price go."""
    p = _vendor_panel(spark, sf_dir)
    n = F.col("ts_code").cast("int")
    close = F.when(F.col("date_idx") % 11 != 0, F.col("close"))
    daily = p.select("ts_code", "trade_date", "open", "high", "low", close.alias("close"), F.col("volume").alias("vol"), "amount")
    basic = p.select("ts_code", "trade_date", "turnover_rate", F.col("market_cap").alias("total_mv"), F.lit(0).alias("limit_status"))
    adj = p.where(n % 4 != 0).select("ts_code", "trade_date", F.lit(2.0).alias("adj_factor"))
    codes = read(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("ts_code"))
    row = lambda name, industry: codes.select("ts_code", name.alias("name"), industry.alias("industry"), F.lit("19900101").alias("list_date"))
    first = row(F.when(n % 3 == 0, "*ST a").otherwise("plain"), F.concat(F.lit("industry "), (n % 5).cast("string")))
    masters = first.unionByName(row(F.when(n % 3 != 0, "*ST b").otherwise("later"), F.lit("later")))
    out = vd.standard_market_data(daily, basic, adj, masters)
    return out.select("ts_code", F.date_format("date", "yyyyMMdd").alias("trade_date"), "industry", "is_st", "adj_factor")


def _shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder (else the warehouse), deleted with the driver's JVM."""
    folder = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{uuid.uuid4().hex}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return at.toString()


@_query(
    "WITH o AS (SELECT *, strftime(o_orderdate, '%Y%m') AS month FROM orders) SELECT o_orderkey, month, CASE WHEN month IN ('199503', '199607') THEN o_totalprice + 1 ELSE o_totalprice END AS price,"
    " CASE WHEN month = '199607' THEN o_orderpriority END AS note FROM o WHERE month BETWEEN '199502' AND '199712'", panel="no"
)
def landed_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders landed by month, two months replaced (one with a new column), a range read."""
    table = LandedTable(spark, _shared_path(spark, "landed"), "month")
    rows = read(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyyMM"))
    kept = rows.select("o_orderkey", "month", F.col("o_totalprice").alias("price"))
    table.land(kept)
    later = kept.withColumn("price", F.col("price") + 1)
    table.land(later.where("month = '199503'"))
    table.land(later.join(rows.select("o_orderkey", F.col("o_orderpriority").alias("note")), "o_orderkey").where("month = '199607'"))
    return table.scan("199502", "199712")


@_query(
    "x AS (SELECT date, date_idx, code, CASE WHEN cast(code AS INT) % 6 = 0 THEN 'UNKNOWN' ELSE industry END AS industry, open, close, CASE WHEN date_idx % 9 <> 0 THEN market_cap END AS market_cap,"
    " CASE WHEN date_idx % 4 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS adj_factor, close * CASE WHEN date_idx % 4 = 0 THEN 1.0 ELSE 2.0 END AS adj_close, listing_days, date_idx % 2 = 0 AS is_st, cast(code AS INT) % 2 = 1 AS is_suspended, has_valid_market_data FROM panel) SELECT * FROM x"
)
def csv_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel written as CSV with other headings, tokens and gaps, and loaded."""
    p, n = panel(spark, sf_dir), F.col("code").cast("int")
    raw = p.select(
        F.when(F.col("date_idx") % 2 == 0, F.date_format("date", "yyyyMMdd")).otherwise(F.col("date").cast("string")).alias("day"),
        F.concat(F.lit(" "), n.cast("string")).alias("stock"),
        F.when(n % 6 == 0, "N/A").otherwise(F.col("industry")).alias("sector"),
        "open", "high", "low", "close", "volume", "amount",
        F.when(F.col("date_idx") % 9 == 0, "-").otherwise(F.col("market_cap").cast("string")).alias("market_cap"),
        F.when(F.col("date_idx") % 4 == 0, 0.0).otherwise(2.0).alias("adj_factor"),
        F.when(F.col("date_idx") % 2 == 0, "2").otherwise("0").alias("is_st"),
        F.when(n % 2 == 1, "Yes").when(n % 4 == 0, "NaN").otherwise("f").alias("is_suspended"),
    )
    c = config()
    c.data.date_col, c.data.code_col, c.data.industry_col = "day", "stock", "sector"
    at = _shared_path(spark, "panel")
    raw.write.option("header", True).csv(at)
    df = mk.standardise(mk.read_csv(spark, at), c.data)
    return df.select(*_KEY, "date_idx", "industry", "open", "close", "market_cap", "adj_factor", "adj_close", "listing_days", "is_st", "is_suspended", "has_valid_market_data")


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1", panel="no")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vd.keep_first(read(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


# --- statistics ---

_VALUES_SQL = f"{_LABEL_SQL.format(source='panel')}, v AS (SELECT date, code, target_rank, {_rank('volume')} AS a, {_rank('market_cap')} AS b, {_rank('amount')} AS c FROM labelled)"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ft.with_targets(fw.dealt_by_date(ft.with_forward_return(panel(spark, sf_dir), 5)))
    return df.select(*_KEY, "target_rank", *(fw.percentile_rank(F.col(x), *_DAY).alias(k) for k, x in (("a", "volume"), ("b", "market_cap"), ("c", "amount"))))


def _corr(a: str, b: str) -> str:
    x, y = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {b} END"
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


_IC_SQL = f"{_VALUES_SQL}, ics AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS feature, date, {_corr(k, 'target_rank')} AS ic FROM v GROUP BY date HAVING count({k} + target_rank) >= 5 AND min(CASE WHEN {k} IS NOT NULL THEN target_rank END) < max(CASE WHEN {k} IS NOT NULL THEN target_rank END) AND min(CASE WHEN target_rank IS NOT NULL THEN {k} END) < max(CASE WHEN target_rank IS NOT NULL THEN {k} END)"
    for k in "abc"
) + ")"


@_query(f"{_IC_SQL} SELECT feature, date, round(ic, 6) AS ic FROM ics")
def daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(mt.daily_ic(_values(spark, sf_dir), ["a", "b", "c"], 5), "feature", "date", ic=F.col("ic"))


@_query(f"{_IC_SQL} SELECT feature, count(*) AS ic_days, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS ic_std, round(avg((ic > 0)::INT), 6) AS positive_ic_fraction FROM ics GROUP BY feature")
def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = mt.ic_summary(mt.daily_ic(_values(spark, sf_dir), ["a", "b", "c"], 5))
    return s.select("feature", "ic_days", *(_rounded(c, 6).alias(c) for c in ("mean_ic", "ic_std", "positive_ic_fraction")))


_NW = " + ".join(["d * d", *(f"CASE WHEN {k} <= least(5, n - 1) THEN 2 * (1 - {k} / (least(5, n - 1) + 1)) ELSE 0 END * d * coalesce(lag(d, {k}) OVER (PARTITION BY feature ORDER BY date), 0)" for k in range(1, 6))])


@_query(f"{_IC_SQL}, c AS (SELECT *, ic - avg(ic) OVER (PARTITION BY feature) AS d, count(*) OVER (PARTITION BY feature) AS n FROM ics), t AS (SELECT feature, ic, n, {_NW} AS term FROM c) SELECT feature, round(avg(ic) / sqrt(sum(term) / count(*) / count(*)), 6) AS ic_tstat FROM t GROUP BY feature")
def newey_west(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(mt.newey_west(mt.daily_ic(_values(spark, sf_dir), ["a", "b", "c"], 5), 5), "feature", ic_tstat=F.col("ic_tstat"))


@_query(f"{_VALUES_SQL} SELECT 'a' AS feature, round(avg((a IS NOT NULL AND target_rank IS NOT NULL)::INT), 6) AS coverage FROM v UNION ALL SELECT 'b', round(avg((b IS NOT NULL AND code <> '000007')::INT), 6) FROM v")
def feature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _values(spark, sf_dir).withColumns({"a": F.when(F.col("target_rank").isNotNull(), F.col("a")), "b": F.when(F.col("code") != "000007", F.col("b"))})
    found = coverage(v, ["a", "b"])
    return spark.createDataFrame(list(found.items()), "feature string, coverage double").select("feature", _rounded("coverage", 6).alias("coverage"))


@_query(f"{_VALUES_SQL} SELECT 'a' AS x, 'b' AS y, round(abs({_corr('a', 'b')}), 6) AS r FROM v UNION ALL SELECT 'a', 'c', round(abs({_corr('a', 'c')}), 6) FROM v UNION ALL SELECT 'b', 'c', round(abs({_corr('b', 'c')}), 6) FROM v")
def pairwise_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.pairwise_correlation(_values(spark, sf_dir), ["a", "b", "c"])
    return spark.createDataFrame([(a, b, r) for (a, b), r in found.items() if a < b], "x string, y string, r double").select("x", "y", _rounded("r", 6).alias("r"))


@_query(f"{_VALUES_SQL} SELECT round(quantile_cont(target_rank, 0.01), 6) AS low, round(quantile_cont(target_rank, 0.99), 6) AS high FROM v")
def winsor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([md.winsor_bounds(_values(spark, sf_dir), 0.01)], "low double, high double").select(_rounded("low", 6).alias("low"), _rounded("high", 6).alias("high"))


@_query(f"{_VALUES_SQL} SELECT unnest(['a', 'b', 'c']) AS feature, unnest([max(a) - min(a) > 1e-10, max(b) - min(b) > 1e-10, false]) AS active FROM v")
def active_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["a", "b", "c"]
    found = md.active_features(_values(spark, sf_dir).withColumn("c", F.lit(0.25)), names)
    return spark.createDataFrame([(n, n in found) for n in names], "feature string, active boolean")


# --- scores and baskets ---

_SCORED_SQL = f"""{_RAW_SQL}, {_LABEL_SQL.format(source='raw')}, ranked AS (SELECT *, {_rank('volatility_20')} AS volatility_20_cs, {_rank('amihud_20')} AS amihud_20_cs, {_rank('volume')} AS m FROM labelled),
{_ELIGIBLE_SQL.format(source='ranked')},
alpha AS (SELECT *, coalesce(m, 0) AS model_score, {_rank('coalesce(m, 0)')} + 0.5 AS alpha_percentile FROM eligible WHERE eligible),
scored AS (SELECT *, alpha_percentile - (0.05 * (coalesce(volatility_20_cs, 0) + 0.5) + 0.05 * (coalesce(amihud_20_cs, 0) + 0.5)) AS selection_score FROM alpha),
placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(selection_score, 9) DESC, code) AS global_rank FROM scored)"""
_TOP_SQL = """pri AS (SELECT *, {held} AND global_rank <= 15 AS kept FROM placed), ind AS (SELECT *, row_number() OVER (PARTITION BY date, industry ORDER BY NOT kept, global_rank) AS ik FROM pri),
turn AS (SELECT *, CASE WHEN ik <= 3 THEN row_number() OVER (PARTITION BY date, ik <= 3 ORDER BY NOT kept, global_rank) END AS t FROM ind),
pos AS (SELECT *, coalesce(t <= 10, false) AS acc, row_number() OVER (PARTITION BY date ORDER BY NOT coalesce(t <= 10, false), CASE WHEN coalesce(t <= 10, false) THEN t END, global_rank) AS candidate_position FROM turn),
basket AS (SELECT *, CASE WHEN NOT acc THEN 'industry_cap_relaxed' WHEN kept THEN 'buffer_keep' ELSE 'new_top_rank' END AS selection_reason FROM pos WHERE candidate_position <= 10)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible rows of all dates with a linear score, ranked. The score is
    compared at nine digits, where both engines agree on ties."""
    c = config()
    df = ft.build_features(panel(spark, sf_dir), c).frame
    df = df.withColumns({k: fw.percentile_rank(F.col(x), *_DAY) for k, x in (("volatility_20_cs", "volatility_20"), ("amihud_20_cs", "amihud_20"), ("m", "volume"))})
    df = df.where("eligible").withColumn("model_score", F.coalesce("m", F.lit(0.0)))
    scored = sl.with_selection_score(df, c.selection, _DAY)
    order = fw.W.partitionBy(*_DAY).orderBy(_rounded("selection_score", 9).desc(), "code")
    return scored.withColumn("global_rank", F.row_number().over(order))


@_query(f"{_SCORED_SQL} SELECT date, code, round(alpha_percentile, 6) AS alpha_percentile, round(selection_score, 6) AS selection_score, global_rank FROM placed")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select(*_KEY, _rounded("alpha_percentile", 6).alias("alpha_percentile"), _rounded("selection_score", 6).alias("selection_score"), "global_rank")


@_query(f"{_SCORED_SQL}, {_TOP_SQL.format(held='false')} SELECT date, code, industry, candidate_position, selection_reason FROM basket")
def topk_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.constrained_top_k(_placed(spark, sf_dir), config().selection, by=_DAY).select(*_KEY, "industry", "candidate_position", "selection_reason")


_HELD = "cast(code AS INT) % 4 = 0"


@_query(f"{_SCORED_SQL}, {_TOP_SQL.format(held=f'({_HELD})')} SELECT date, code, candidate_position, selection_reason FROM basket")
def topk_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sl.constrained_top_k(_placed(spark, sf_dir), config().selection, F.expr(_HELD), _DAY).select(*_KEY, "candidate_position", "selection_reason")


_BASKET_SQL = f"{_SCORED_SQL}, {_TOP_SQL.format(held='false')}"


@_query(f"{_BASKET_SQL} SELECT date, count(*) AS candidate_count, round(avg(forward_return), 6) AS basket_forward_return, round(avg(target_excess_return), 6) AS basket_excess_return, round(avg(coalesce(target_excess_return > 0, false)::INT), 6) AS positive_excess_rate, round(avg(coalesce(target_rank >= 0.3, false)::INT), 6) AS precision_top_20pct FROM basket GROUP BY date")
def basket_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mt.basket_metrics(sl.constrained_top_k(_placed(spark, sf_dir), config().selection, by=_DAY))
    return found.select("date", "candidate_count", *(_rounded(c, 6).alias(c) for c in ("basket_forward_return", "basket_excess_return", "positive_excess_rate", "precision_top_20pct")))


@_query(f"{_BASKET_SQL}, h AS (SELECT date_idx AS period, code FROM basket), s AS (SELECT period, count(*) AS n FROM h GROUP BY 1), b AS (SELECT h.period, count(*) AS k FROM h JOIN h g ON g.period = h.period - 1 AND g.code = h.code GROUP BY 1) SELECT s.period, round(CASE WHEN p.n IS NOT NULL THEN 1 - coalesce(k, 0) / greatest(s.n, p.n, 1) END, 6) AS turnover FROM s LEFT JOIN s p ON p.period = s.period - 1 LEFT JOIN b ON b.period = s.period")
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = sl.constrained_top_k(_placed(spark, sf_dir), config().selection, by=_DAY).select(F.col("date_idx").alias("period"), "code")
    return _out(mt.turnover(held), "period", turnover=F.col("turnover"))


def _average_rank_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + count({x}) OVER (PARTITION BY date ORDER BY {x} NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 2 END"


@_query(f"{_SCORED_SQL}, k AS (SELECT date, {_average_rank_sql('model_score')} AS a, {_average_rank_sql('target_excess_return')} AS b FROM placed) SELECT date, round({_corr('a', 'b')}, 6) AS spearman_ic FROM k GROUP BY date")
def spearman_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(mt.spearman_ic(_placed(spark, sf_dir)), "date", spearman_ic=F.col("spearman_ic"))


@_query(f"{_BASKET_SQL}, r AS (SELECT date, avg(forward_return) AS x FROM basket GROUP BY date) SELECT round(avg(x) / stddev_samp(x) * sqrt(252.0 / 5), 5) AS sharpe, count(x) AS n FROM r")
def sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    periods = mt.basket_metrics(sl.constrained_top_k(_placed(spark, sf_dir), config().selection, by=_DAY))
    x = F.col("basket_forward_return")
    return periods.agg(_rounded(mt.sharpe(5, x), 5).alias("sharpe"), F.count(x).alias("n"))


# --- expressions, screening, model, backtest ---

_DSL = {
    "ai_calm": "safe_div(delta(adj_close, 5), rolling_std(adj_close, 20))",
    "ai_turn": "-(lag(amount, 1) / 2 - rolling_mean(amount, 10)) * 0.5",
    "ai_peak": "clip(minimum(ts_zscore(adj_close, 10), signed_log1p(volume)), -1, 2)",
    "ai_nest": "rolling_max(pct_change(adj_close, 2), 5) + abs(turnover_rate)",
}


@_query(
    f"a AS (SELECT *, {_roll('stddev_pop', 'adj_close', 20)} AS s20, {_roll('avg', 'amount', 10)} AS m10, {_roll('avg', 'adj_close', 10)} AS zm, {_roll('stddev_pop', 'adj_close', 10)} AS zs, adj_close / nullif(lag(adj_close, 2) {_BY}, 0) - 1 AS g2, lag(amount) {_BY} AS la, adj_close - lag(adj_close, 5) {_BY} AS d5 FROM panel),"
    f" b AS (SELECT *, CASE WHEN zs > 1e-12 THEN (adj_close - zm) / zs END AS z, ln(1 + volume) AS lv FROM a) SELECT date, code, round(CASE WHEN abs(s20) > 1e-12 THEN d5 / s20 END, 5) AS ai_calm, round(-(la / 2 - m10) * 0.5, 3) AS ai_turn,"
    f" round(CASE WHEN z IS NOT NULL THEN greatest(-1, least(least(z, lv), 2)) END, 5) AS ai_peak, round({_roll('max', 'g2', 5)} + abs(turnover_rate), 5) AS ai_nest FROM b"
)
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compile_features(_DSL, {"adj_close", "amount", "volume", "turnover_rate"}).apply(panel(spark, sf_dir))
    return df.select(*_KEY, _rounded("ai_calm", 5).alias("ai_calm"), _rounded("ai_turn", 3).alias("ai_turn"), _rounded("ai_peak", 5).alias("ai_peak"), _rounded("ai_nest", 5).alias("ai_nest"))


_DSL_MORE = {
    "ai_most": "maximum(lag(volume, 3), volume) / 2",
    "ai_floor": "rolling_min(amount, 5)",
    "ai_total": "rolling_sum(volume, 10) - 1",
}


@_query(
    f"a AS (SELECT *, lag(volume, 3) {_BY} AS l3 FROM panel) SELECT date, code, round(CASE WHEN l3 IS NOT NULL THEN greatest(l3, volume) / 2 END, 6) AS ai_most,"
    f" round({_roll('min', 'amount', 5)}, 4) AS ai_floor, round({_roll('sum', 'volume', 10)} - 1, 6) AS ai_total FROM a"
)
def expressions_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = compile_features(_DSL_MORE, {"amount", "volume"}).apply(panel(spark, sf_dir))
    return df.select(*_KEY, _rounded("ai_most", 6).alias("ai_most"), _rounded("ai_floor", 4).alias("ai_floor"), _rounded("ai_total", 6).alias("ai_total"))


# weight w of the mean so far decays over gaps; n values were seen
_EMA_GAPS = f"""n AS (SELECT code, date, CASE WHEN date_idx % 7 <> 0 THEN adj_close - lag(adj_close, 1) {_BY} END AS v, row_number() {_BY} AS i FROM panel),
    e AS (SELECT code, date, i, v AS y, 1.0::DOUBLE AS w, (v IS NOT NULL)::INT AS seen FROM n WHERE i = 1 UNION ALL
        SELECT n.code, n.date, n.i, CASE WHEN e.y IS NULL THEN n.v WHEN n.v IS NULL THEN e.y ELSE (e.w * (1 - 2.0 / 5) * e.y + 2.0 / 5 * n.v) / (e.w * (1 - 2.0 / 5) + 2.0 / 5) END,
        CASE WHEN n.v IS NOT NULL OR e.y IS NULL THEN 1.0 ELSE e.w * (1 - 2.0 / 5) END, e.seen + (n.v IS NOT NULL)::INT FROM e JOIN n ON n.code = e.code AND n.i = e.i + 1)
    SELECT date, code, round(CASE WHEN seen >= 4 THEN y END, 5) AS ai_smooth FROM e"""


@_query(_EMA_GAPS)
def expressions_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language's exponential mean over a difference with gaps."""
    p = panel(spark, sf_dir).select(*_KEY, "date_idx", "adj_close")
    p = p.withColumn("volume", F.when(F.col("date_idx") % 7 != 0, 1.0))
    df = compile_features({"ai_smooth": "ema(delta(adj_close, 1) * volume, 4)"}, {"adj_close", "volume"}).apply(p)
    return df.select(*_KEY, _rounded("ai_smooth", 5).alias("ai_smooth"))


ORACLES["expressions_ema"] = ORACLES["expressions_ema"].replace("WITH ", "WITH RECURSIVE ", 1)


_SCREENED = _DSL | {"ai_calm_again": f"2 * {_DSL['ai_calm']}", "ai_ema": "ema(adj_close, 5) / adj_close"}
_CALM = "CASE WHEN abs(s20) > 1e-12 THEN d5 / s20 END"
# the features' values as floats, as the engine keeps them before ranking
_SCREEN_SQL = f"""{_RAW_SQL}, {_LABEL_SQL.format(source="raw")}, {_ELIGIBLE_SQL.format(source="labelled")},
n AS (SELECT code, date, adj_close AS v, row_number() {_BY} AS i FROM panel),
means AS (SELECT code, date, i, v AS y FROM n WHERE i = 1 UNION ALL SELECT n.code, n.date, n.i, means.y * (1 - 2.0 / 6) + n.v * (2.0 / 6) FROM means JOIN n ON n.code = means.code AND n.i = means.i + 1),
w AS (SELECT *, {_roll("stddev_pop", "adj_close", 20)} AS s20, {_roll("avg", "amount", 10)} AS m10, {_roll("avg", "adj_close", 10)} AS zm, {_roll("stddev_pop", "adj_close", 10)} AS zs,
    adj_close / nullif(lag(adj_close, 2) {_BY}, 0) - 1 AS g2, lag(amount) {_BY} AS la, adj_close - lag(adj_close, 5) {_BY} AS d5 FROM eligible),
z AS (SELECT *, CASE WHEN zs > 1e-12 THEN (adj_close - zm) / zs END AS z10, ln(1 + volume) AS lv, {_roll("max", "g2", 5)} AS top FROM w),
made AS (SELECT z.date, z.code, z.eligible, z.target_rank, ({_CALM})::FLOAT AS ai_calm, (-(la / 2 - m10) * 0.5)::FLOAT AS ai_turn, (CASE WHEN z10 IS NOT NULL THEN greatest(-1, least(least(z10, lv), 2)) END)::FLOAT AS ai_peak,
    (top + abs(turnover_rate))::FLOAT AS ai_nest, (2 * {_CALM})::FLOAT AS ai_calm_again, (CASE WHEN i >= 5 THEN y / adj_close END)::FLOAT AS ai_ema FROM z JOIN means USING (code, date)),
ranked AS (SELECT *, {", ".join(f"({_rank(x)})::FLOAT::DOUBLE AS {x}_cs" for x in _SCREENED)} FROM made),
v AS (SELECT * FROM ranked WHERE eligible AND target_rank IS NOT NULL),
ics AS ({" UNION ALL ".join(
    f"SELECT '{k}' AS feature, date, {_corr(f'{k}_cs', 'target_rank')} AS ic FROM v GROUP BY date HAVING count({k}_cs) >= 5 AND min(CASE WHEN {k}_cs IS NOT NULL THEN target_rank END) < max(CASE WHEN {k}_cs IS NOT NULL THEN target_rank END) AND min({k}_cs) < max({k}_cs)"
    for k in _SCREENED
)}),
c AS (SELECT *, ic - avg(ic) OVER (PARTITION BY feature) AS d, count(*) OVER (PARTITION BY feature) AS n FROM ics), t AS (SELECT feature, ic, n, {_NW} AS term FROM c),
stat AS (SELECT feature, count(*) AS ic_days, avg(ic) AS mean_ic, stddev_samp(ic) AS ic_std, avg((ic > 0)::INT) AS positive_ic_fraction,
    CASE WHEN count(*) > 1 AND sum(term) > 0 THEN avg(ic) / sqrt(sum(term) / count(*) / count(*)) END AS ic_tstat FROM t GROUP BY feature),
named AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{k}', '{x}')" for i, (k, x) in enumerate(_SCREENED.items()))}) AS f(pos, name, expression)),
cover AS ({" UNION ALL ".join(f"SELECT '{k}' AS feature, avg(({k}_cs IS NOT NULL)::INT) AS coverage FROM v" for k in _SCREENED)}),
told AS (SELECT named.*, coverage, coalesce(ic_days, 0) AS ic_days, mean_ic, ic_std, ic_tstat, positive_ic_fraction,
    concat_ws(',', CASE WHEN coverage < 0.2 THEN 'coverage' END, CASE WHEN coalesce(ic_days, 0) < 10 THEN 'screening_days' END, CASE WHEN mean_ic IS NULL THEN 'mean_ic' END, CASE WHEN ic_tstat IS NULL THEN 'ic_tstat' END) AS why
    FROM named JOIN cover ON cover.feature = name LEFT JOIN stat ON stat.feature = name),
line AS (SELECT name, row_number() OVER (ORDER BY round(abs(mean_ic), 9) DESC, pos) AS i FROM told WHERE why = ''),
pairs AS ({" UNION ALL ".join(f"SELECT '{x}' AS x, '{y}' AS y, coalesce(abs({_corr(f'{x}_cs', f'{y}_cs')}), 0) AS r FROM v" for x in _SCREENED for y in _SCREENED if x != y)}),
chosen AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS name, []::VARCHAR[] AS taken, NULL::DOUBLE AS worst, NULL::VARCHAR AS other UNION ALL
    SELECT i, name, CASE WHEN worst > 0.85 THEN taken ELSE list_append(taken, name) END, worst, other FROM (
        SELECT line.i, line.name, chosen.taken, coalesce(max(r), 0) AS worst, CASE WHEN coalesce(max(r), 0) > 0 THEN arg_max(y, r) ELSE '' END AS other
        FROM chosen JOIN line ON line.i = chosen.i + 1 LEFT JOIN pairs ON pairs.x = line.name AND list_contains(chosen.taken, pairs.y) GROUP BY line.i, line.name, chosen.taken) step)
SELECT told.name, expression, round(coverage, 6) AS coverage, ic_days, round(mean_ic, 6) AS mean_ic, round(ic_std, 6) AS ic_std, round(ic_tstat, 5) AS ic_tstat, round(positive_ic_fraction, 6) AS positive_ic_fraction,
    'newey_west' AS ic_tstat_method, 5 AS ic_hac_lags, CASE WHEN why <> '' THEN 'rejected_threshold' WHEN worst > 0.85 THEN 'rejected_redundancy' ELSE 'accepted' END AS status,
    CASE WHEN why <> '' THEN why WHEN worst > 0.85 THEN 'pairwise_correlation' ELSE '' END AS rejection_reason, round(worst, 6) AS max_abs_correlation, coalesce(other, '') AS correlated_with
    FROM told LEFT JOIN chosen ON chosen.name = told.name"""


@_query(_SCREEN_SQL)
def screening_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = [FeatureDefinition(k, v, "A test of the screener.") for k, v in _SCREENED.items()]
    report = screen_feature_definitions(panel(spark, sf_dir), config(), definitions).report
    digits = {"coverage": 6, "mean_ic": 6, "ic_std": 6, "ic_tstat": 5, "positive_ic_fraction": 6, "max_abs_correlation": 6}
    return report.select(*(_rounded(x, digits[x]).alias(x) if x in digits else x for x in report.columns if x not in ("rationale", "expected_direction")))


ORACLES["screening_report"] = ORACLES["screening_report"].replace("WITH ", "WITH RECURSIVE ", 1)


@_query(
    f"{_RAW_SQL}, {_LABEL_SQL.format(source='raw')}, {_ELIGIBLE_SQL.format(source='labelled')}, e AS (SELECT max(date_idx) - 6 AS last FROM panel WHERE date <= DATE '1997-06-30')"
    " SELECT date, count(*) AS n FROM eligible, e WHERE eligible AND target_rank IS NOT NULL AND date >= DATE '1994-01-01' AND date_idx <= last GROUP BY date"
)
def screening_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by date of a screening period whose labels are known by its end."""
    rows, _ = screening_window(ft.build_features(panel(spark, sf_dir), config()).frame, 5, "1994-01-01", "1997-06-30")
    return rows.groupBy("date").agg(F.count("*").alias("n"))


@_query()
def gbt_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    selector = CandidateSelector(config())
    return selector.select_prepared(selector.prepare(panel(spark, sf_dir))).candidates.select(*_KEY, "industry", "candidate_position", "selection_reason", "selection_score")


_float_rank = lambda x: f"({_rank(x)})::FLOAT::DOUBLE"
# eligible rows of all dates with the linear score, ranked by the scores' own bits
_LINEAR_SQL = f"""{_RAW_SQL}, {_LABEL_SQL.format(source="raw")},
ranked AS (SELECT *, {_float_rank("volatility_20")} AS volatility_20_cs, {_float_rank("amihud_20")} AS amihud_20_cs, {_float_rank("momentum_20")} AS momentum_20_cs, {_float_rank("volume_ratio_20")} AS volume_ratio_20_cs FROM labelled),
{_ELIGIBLE_SQL.format(source="ranked")},
alpha AS (SELECT *, coalesce(momentum_20_cs, 0) + coalesce(volume_ratio_20_cs, 0) * 0.5 AS model_score FROM eligible WHERE eligible),
alphas AS (SELECT *, {_rank("model_score")} + 0.5 AS alpha_percentile FROM alpha),
scored AS (SELECT *, alpha_percentile - (0.05 * (coalesce(volatility_20_cs, 0) + 0.5) + 0.05 * (coalesce(amihud_20_cs, 0) + 0.5)) AS selection_score FROM alphas),
placed AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY selection_score DESC, code) AS global_rank FROM scored)"""
_LINEAR = {"momentum_20_cs": 1.0, "volume_ratio_20_cs": 0.5}

_TREE = ("volatility_20_cs", "amihud_20_cs", "momentum_20_cs", "volume_ratio_20_cs")
_GAIN = lambda g, n: f"power(greatest(abs({g}) - 0.1, 0), 2) / ({n} + 1.0)"


@_query(
    f"""{_RAW_SQL}, {_LABEL_SQL.format(source="raw")},
ranked AS (SELECT *, {", ".join(f"{_float_rank(x.removesuffix('_cs'))} AS {x}" for x in _TREE)} FROM labelled), {_ELIGIBLE_SQL.format(source="ranked")},
e AS (SELECT max(date_idx) - 6 AS last FROM panel),
train AS (SELECT eligible.* FROM eligible, e WHERE eligible AND target_rank IS NOT NULL AND date_idx BETWEEN last - 119 AND last),
clipped AS (SELECT *, least(greatest(target_rank, quantile_cont(target_rank, 0.01) OVER ()), quantile_cont(target_rank, 0.99) OVER ()) AS y FROM train),
cells AS ({" UNION ALL ".join(f"SELECT '{x}' AS feature, {x} AS x, avg(y) OVER () - y AS g FROM clipped" for x in _TREE)}),
ends AS (SELECT feature, min(x) AS low, max(x) AS high, sum(g) AS g, count(*) AS n, coalesce(sum(g) FILTER (x IS NULL), 0) AS mg, count(*) FILTER (x IS NULL) AS mn FROM cells GROUP BY feature),
hist AS (SELECT feature, least(254, floor((x - low) / (high - low) * 255.0))::BIGINT AS bin, sum(cells.g) AS g, count(*) AS n FROM cells JOIN ends USING (feature) WHERE x IS NOT NULL GROUP BY ALL),
sides AS (SELECT feature, bin, missing_left, ends.g, ends.n, sum(hist.g) OVER w + CASE WHEN missing_left THEN mg ELSE 0 END AS lg, sum(hist.n) OVER w + CASE WHEN missing_left THEN mn ELSE 0 END AS ln
    FROM hist JOIN ends USING (feature), (VALUES (false), (true)) AS m(missing_left) WINDOW w AS (PARTITION BY feature, missing_left ORDER BY bin)),
gains AS (SELECT *, {_GAIN("lg", "ln")} + {_GAIN("g - lg", "n - ln")} - {_GAIN("g", "n")} AS gain FROM sides WHERE ln >= 20 AND n - ln >= 20),
best AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(gain, 9) DESC, bin, missing_left) AS i FROM gains WHERE gain > 0)
SELECT feature, bin, missing_left, ln::BIGINT AS left_rows, round(gain, 5) AS gain FROM best WHERE i = 1"""
)
def gbt_first_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best first split of each of four features, all rows taking part."""
    c = config()
    c.model.subsample = c.model.colsample_bytree = 1.0
    window = md.training_window(ft.build_features(panel(spark, sf_dir), c).frame, c)
    x = md.fit_input(window.rows, _TREE, c.model)
    found = bo.first_splits(x.rows, x.active, x.lows, x.highs, x.target, x.key, c.model)
    x.rows.unpersist()
    rows = [(x.active[s.feature], s.bin, s.missing_left, s.left[1], s.gain) for s in found if s]
    return spark.createDataFrame(rows, "feature string, bin long, missing_left boolean, left_rows long, gain double").withColumn("gain", _rounded(F.col("gain"), 5))


# each period's basket keeps members of the one before, so baskets are made one after the other
_TOP_OF_HELD = _TOP_SQL.format(held="held").replace("FROM placed", "FROM {source}")
_BACKTEST_SQL = f"""{_LINEAR_SQL},
dates AS (SELECT date, row_number() OVER (ORDER BY date) AS period FROM calendar, (SELECT count(*) AS n FROM calendar) WHERE date_idx >= 66 AND date_idx < n - 6 AND (date_idx - 66) % 20 = 0),
universe AS MATERIALIZED (SELECT placed.*, period FROM placed JOIN dates USING (date)),
chain AS (SELECT 0::BIGINT AS period, []::VARCHAR[] AS codes UNION ALL
    SELECT period, list(code) FROM (WITH {_TOP_OF_HELD.format(source="(SELECT u.*, list_contains(chain.codes, u.code) AS held FROM chain JOIN universe u ON u.period = chain.period + 1)")} SELECT period, code FROM basket) step GROUP BY period),
{_TOP_OF_HELD.format(source="(SELECT u.*, list_contains(chain.codes, u.code) AS held FROM chain JOIN universe u ON u.period = chain.period + 1)")},
sizes AS (SELECT period, count(*) AS n FROM basket GROUP BY period),
met AS (SELECT b.period, count(*) AS k FROM basket b JOIN basket g ON g.period = b.period - 1 AND g.code = b.code GROUP BY b.period),
changed AS (SELECT s.period, CASE WHEN p.n IS NOT NULL THEN 1 - coalesce(k, 0) / greatest(s.n, p.n, 1) END AS turnover FROM sizes s LEFT JOIN sizes p ON p.period = s.period - 1 LEFT JOIN met ON met.period = s.period),
orders_of AS (SELECT period, {_average_rank_sql("model_score")} AS a, {_average_rank_sql("target_excess_return")} AS b FROM universe),
whole AS (SELECT period, count(*) AS eligible_count, {_corr("a", "b")} AS spearman_ic FROM orders_of GROUP BY period),
periods AS (SELECT period, date, count(*) AS candidate_count, avg(forward_return) AS basket_forward_return, avg(target_excess_return) AS basket_excess_return,
    avg(coalesce(target_excess_return > 0, false)::INT) AS positive_excess_rate, avg(coalesce(target_rank >= 0.3, false)::INT) AS precision_top_20pct FROM basket GROUP BY period, date)"""
_MEANS = ("basket_forward_return", "basket_excess_return", "precision_top_20pct", "spearman_ic", "turnover")
_PERIOD = ("basket_forward_return", "basket_excess_return", "positive_excess_rate", "precision_top_20pct", "spearman_ic", "turnover")


@_query(
    f"{_BACKTEST_SQL}, every AS (SELECT * FROM periods JOIN whole USING (period) JOIN changed USING (period)),"
    f" summary AS (SELECT strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date, count(*) AS periods, {', '.join(f'avg({x}) AS mean_{x}' for x in _MEANS)},"
    " avg(basket_forward_return) / stddev_samp(basket_forward_return) * sqrt(252.0 / 20) AS period_return_sharpe FROM every)"
    f" SELECT date, code, b.industry, candidate_position, global_rank, round(selection_score, 6) AS selection_score, round(forward_return, 6) AS forward_return, selection_reason, candidate_count, eligible_count,"
    f" {', '.join(f'round({x}, 6) AS {x}' for x in _PERIOD)}, start_date, end_date, periods, 10 AS top_k, 5 AS prediction_horizon_days, 20 AS rebalance_every_days, {', '.join(f'round(mean_{x}, 6) AS mean_{x}' for x in _MEANS)},"
    " round(period_return_sharpe, 5) AS period_return_sharpe FROM basket b JOIN every USING (date), summary"
)
def backtest_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The holdings, each with its period's metrics and the summary."""
    selector = CandidateSelector(config(), md.LinearScore(_LINEAR))
    found = selector.backtest_prepared(selector.prepare(panel(spark, sf_dir)))
    held = found.holdings.select(*_KEY, "industry", "candidate_position", "global_rank", *(_rounded(x, 6).alias(x) for x in ("selection_score", "forward_return")), "selection_reason")
    rows = held.join(_out(found.periods, "date", "candidate_count", "eligible_count", **{x: F.col(x) for x in _PERIOD}), "date")
    told = {k: F.lit(x) if isinstance(x, (str, int)) else _rounded(F.lit(x).cast("double"), 5 if "sharpe" in k else 6) for k, x in found.summary.items()}
    return rows.withColumns(told)


ORACLES["backtest_linear"] = ORACLES["backtest_linear"].replace("WITH ", "WITH RECURSIVE ", 1)


_AT = "DATE '1997-06-30'"


@_query(
    f"{_LINEAR_SQL}, last_day AS (SELECT max(date_idx) AS last, max(date) AS day FROM panel WHERE date <= {_AT}), today AS (SELECT placed.*, cast(code AS INT) BETWEEN 1 AND 40 AS held FROM placed, last_day WHERE date = day), {_TOP_OF_HELD.format(source='today')},"
    " fitted AS (SELECT count(*) AS training_rows FROM eligible, last_day WHERE eligible AND target_rank IS NOT NULL AND date_idx BETWEEN last - 125 AND last - 6)"
    " SELECT date, code, industry, candidate_position, global_rank, round(selection_score, 6) AS selection_score, selection_reason, training_rows, (SELECT date FROM calendar, last_day WHERE date_idx = last - 125) AS training_start, (SELECT date FROM calendar, last_day WHERE date_idx = last - 6) AS training_end, 120 AS training_days, (SELECT count(*) FROM today) AS eligible_stocks, 3 AS industry_cap FROM basket, fitted"
)
def selection_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One date's selection with an earlier basket, and its diagnostics."""
    selector = CandidateSelector(config(), md.LinearScore(_LINEAR))
    found = selector.select_prepared(selector.prepare(panel(spark, sf_dir)), "1997-06-30", [str(i) for i in range(1, 41)])
    d = found.diagnostics
    rows = found.candidates.select(*_KEY, "industry", "candidate_position", "global_rank", _rounded("selection_score", 6).alias("selection_score"), "selection_reason")
    told = {"training_rows": d.training_rows, "training_start": F.lit(d.training_start).cast("date"), "training_end": F.lit(d.training_end).cast("date"), "training_days": d.training_days}
    told |= {"eligible_stocks": d.eligible_stocks, "industry_cap": d.industry_cap}
    return rows.withColumns({k: F.lit(x) if isinstance(x, int) else x for k, x in told.items()})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five of the last date by momentum, less risk penalties."""
    c = config()
    c.selection.top_k = 5
    frame = ft.build_features(panel(spark, sf_dir), c).frame
    rows = frame.where("eligible").withColumn("model_score", F.coalesce(F.col("momentum_20_cs").cast("double"), F.lit(0.0)))
    last = rows.agg(F.max("date").alias("date"))
    today = sl.with_selection_score(rows.join(F.broadcast(last), "date"), c.selection)
    return sl.constrained_top_k(today, c.selection).select(*_KEY, "industry", "candidate_position", "global_rank", _rounded("selection_score", 6).alias("selection_score"), "selection_reason")


