"""Statistics of features and baskets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.windows import average_rank


def correlation(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's, over rows that have both; NULL if either is constant."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def daily_ic(values: DataFrame, columns: Sequence[str], least: int) -> DataFrame:
    """(feature, date, ic) of each column with target_rank, in one aggregation by
    date. Days with fewer than `least` pairs, or a constant side, are left out."""
    parts = []
    for i, c in enumerate(columns):
        both = F.col(c).isNotNull() & F.col("target_rank").isNotNull()
        x, y = F.when(both, F.col(c)), F.when(both, F.col("target_rank"))
        usable = (F.count(x) >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        parts.append(F.when(usable, correlation(F.col(c), F.col("target_rank"))).alias(f"ic{i}"))
    daily = values.groupBy("date").agg(*parts)
    pairs = F.array(*(F.struct(F.lit(c).alias("feature"), F.col(f"ic{i}").alias("ic")) for i, c in enumerate(columns)))
    return daily.select("date", F.inline(pairs)).where("ic IS NOT NULL").select("feature", "date", "ic")


def newey_west(ics: DataFrame, max_lag: int) -> DataFrame:
    """(feature, t): the mean's t-statistic with Bartlett weights over lags of
    kept days. NULL for fewer than two days or a variance that isn't positive."""
    by, order = W.partitionBy("feature"), W.partitionBy("feature").orderBy("date")
    c = ics.select("feature", "date", "ic", F.avg("ic").over(by).alias("mean"), F.count("*").over(by).alias("n"))
    c = c.withColumn("d", F.col("ic") - F.col("mean")).withColumn("lags", F.least(F.lit(max(0, max_lag)), F.col("n") - 1))
    terms = F.col("d") * F.col("d")
    for k in range(1, max_lag + 1):
        weight = F.when(F.lit(k) <= F.col("lags"), 2.0 * (1.0 - k / (F.col("lags") + 1.0))).otherwise(0.0)
        terms = terms + weight * F.col("d") * F.coalesce(F.lag("d", k).over(order), F.lit(0.0))
    summed = c.withColumn("term", terms).groupBy("feature").agg(F.first("mean").alias("mean"), F.count("*").alias("n"), (F.sum("term") / F.count("*")).alias("variance"))
    return summed.select("feature", F.when((F.col("n") > 1) & (F.col("variance") > 0), F.try_divide("mean", F.sqrt(F.col("variance") / F.col("n")))).alias("ic_tstat"))


def ic_summary(ics: DataFrame) -> DataFrame:
    return ics.groupBy("feature").agg(
        F.count("*").alias("ic_days"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("ic_std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_ic_fraction")
    )


def pairwise_correlation(values: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """Absolute correlations of all pairs of columns, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    if not pairs:
        return {}
    row = values.agg(*(F.abs(correlation(F.col(a), F.col(b))).alias(f"x{i}") for i, (a, b) in enumerate(pairs))).first()
    return {p: row[i] for i, p in enumerate(pairs)} | {(b, a): row[i] for i, (a, b) in enumerate(pairs)}


def spearman_ic(scored: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """(by..., spearman_ic): of model_score and target_excess_return, ranked each
    over all its values before pairs are formed."""
    ranked = scored.select(*by, average_rank(F.col("model_score"), *by).alias("a"), average_rank(F.col("target_excess_return"), *by).alias("b"))
    return ranked.groupBy(*by).agg(correlation(F.col("a"), F.col("b")).alias("spearman_ic"))


def basket_metrics(baskets: DataFrame, by: Sequence[str] = ("date",)) -> DataFrame:
    """A comparison with a missing value counts as false, not as missing."""
    share = lambda x: F.avg(F.coalesce(x, F.lit(False)).cast("double"))
    return baskets.groupBy(*by).agg(
        F.count("*").alias("candidate_count"),
        F.avg("forward_return").alias("basket_forward_return"),
        F.avg("target_excess_return").alias("basket_excess_return"),
        share(F.col("target_excess_return") > 0).alias("positive_excess_rate"),
        share(F.col("target_rank") >= 0.30).alias("precision_top_20pct"),
    )


def turnover(holdings: DataFrame) -> DataFrame:
    """(period, turnover) of holdings (period, code), periods numbered without
    gaps: the share of the larger basket that changed; NULL for the first."""
    sizes = holdings.groupBy("period").agg(F.count_distinct("code").alias("n"))
    now, before = holdings.select("period", "code").distinct(), holdings.select((F.col("period") + 1).alias("period"), "code").distinct()
    both = now.join(before, ["period", "code"]).groupBy("period").agg(F.count("*").alias("both"))
    last = sizes.select((F.col("period") + 1).alias("period"), F.col("n").alias("n before"))
    joined = sizes.join(last, "period", "left").join(both, "period", "left")
    rate = 1.0 - F.coalesce("both", F.lit(0)) / F.greatest("n", "n before", F.lit(1))
    return joined.select("period", F.when(F.col("n before").isNotNull(), rate).alias("turnover"))


def sharpe(step: int, x: Column) -> Column:
    """Aggregate: annualised, of returns every `step` days; NULL if undefined."""
    spread = F.stddev_samp(x)
    return F.when((F.count(x) > 1) & (spread > 0), F.try_divide(F.avg(x), spread) * math.sqrt(252.0 / step))
