"""Scores, ranks and the constrained Top-K of one or many score dates."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SelectionConfig
from ..functions.windows import percentile_rank


def risk_percentile(rank: Column) -> Column:
    """From a rank in (-0.5, 0.5] to (0, 1]; a missing one is neutral."""
    return F.least(F.greatest(F.coalesce(rank, F.lit(0.0)), F.lit(-0.5)), F.lit(0.5)) + 0.5


def with_selection_score(scored: DataFrame, config: SelectionConfig, by: Sequence[str] = ("date",)) -> DataFrame:
    """alpha_percentile, selection_score and global_rank of rows with model_score,
    volatility_20_cs and amihud_20_cs, within each value of `by`."""
    alpha = percentile_rank(F.col("model_score"), *by) + 0.5
    df = scored.withColumn("alpha_percentile", alpha)
    penalty = config.volatility_penalty * risk_percentile(F.col("volatility_20_cs").cast("double"))
    penalty = penalty + config.illiquidity_penalty * risk_percentile(F.col("amihud_20_cs").cast("double"))
    df = df.withColumn("selection_score", F.col("alpha_percentile") - penalty)
    order = W.partitionBy(*by).orderBy(F.col("selection_score").desc_nulls_last(), "code")
    return df.withColumn("global_rank", F.row_number().over(order))


def industry_cap(config: SelectionConfig) -> int:
    return max(1, math.ceil(config.top_k * config.max_industry_fraction))


def constrained_top_k(ranked: DataFrame, config: SelectionConfig, previous: Iterable[str] | Column | None = None, by: Sequence[str] = ("date",)) -> DataFrame:
    """The basket of each value of `by` from rows with code, industry and
    global_rank: selection_reason and candidate_position are added.

    Earlier members within the buffer come first, then the others, by rank. Of
    each industry the first `cap` in that order can be accepted (whether a row is
    over the cap depends on earlier rows of its industry only, so a row number
    per industry decides it, without a loop); if these are fewer than top_k, the
    best of the rest fill the basket. previous: codes, or a boolean column.
    """
    k, cap = config.top_k, industry_cap(config)
    buffer = math.ceil(k * config.buffer_exit_multiplier)
    if previous is None:
        held = F.lit(False)
    elif isinstance(previous, Column):
        held = F.coalesce(previous, F.lit(False))
    else:
        held = F.col("code").isin([str(c).strip().zfill(6) for c in previous])
    df = ranked.withColumn("kept over", held & (F.col("global_rank") <= buffer))
    first = (~F.col("kept over"), F.col("global_rank"))
    df = df.withColumn("in industry", F.row_number().over(W.partitionBy(*by, "industry").orderBy(*first)))
    df = df.withColumn("capped", F.col("in industry") <= cap)
    # accepted: the first k of those under the cap; then, by rank, the others
    df = df.withColumn("turn", F.when(F.col("capped"), F.row_number().over(W.partitionBy(*by, "capped").orderBy(*first))))
    df = df.withColumn("accepted", F.coalesce(F.col("turn") <= k, F.lit(False)))
    place = W.partitionBy(*by).orderBy(~F.col("accepted"), F.when(F.col("accepted"), F.col("turn")), "global_rank")
    df = df.withColumn("candidate_position", F.row_number().over(place)).where(F.col("candidate_position") <= k)
    reason = F.when(~F.col("accepted"), "industry_cap_relaxed").when(F.col("kept over"), "buffer_keep").otherwise("new_top_rank")
    return df.withColumn("selection_reason", reason).drop("kept over", "in industry", "capped", "turn", "accepted")


def contenders(ranked: DataFrame, config: SelectionConfig, by: str = "period") -> DataFrame:
    """The rows that can be in a basket of constrained_top_k, whichever codes were
    held before: at most max(buffer, 2 k) + 2 k of each value of `by`.

    Who is kept over is within the buffer. Who else is accepted is among the first
    `cap` of its industry, and is preceded there by at most k accepted ones and
    the at most k that kept ones push over a cap. Who fills a basket up is among
    the first 2 k of all."""
    k, cap = config.top_k, industry_cap(config)
    buffer = math.ceil(k * config.buffer_exit_multiplier)
    capped = F.row_number().over(W.partitionBy(by, "industry").orderBy("global_rank")) <= cap
    df = ranked.withColumn("capped", capped)
    turn = F.row_number().over(W.partitionBy(by, "capped").orderBy("global_rank"))
    df = df.withColumn("turn", turn).where((F.col("global_rank") <= max(buffer, 2 * k)) | (F.col("capped") & (F.col("turn") <= 2 * k)))
    return df.drop("capped", "turn")


def _basket(rows: pd.DataFrame, held: Iterable[str], config: SelectionConfig) -> pd.DataFrame:
    """constrained_top_k of one period's contenders."""
    k, buffer = config.top_k, math.ceil(config.top_k * config.buffer_exit_multiplier)
    rows = rows.assign(fresh=~(rows["code"].isin(held) & (rows["global_rank"] <= buffer))).sort_values(["fresh", "global_rank"])
    capped = rows.groupby("industry", dropna=False).cumcount() < industry_cap(config)
    rows["relaxed"] = ~(capped & (capped.cumsum() <= k))
    rows["fresh"] |= rows["relaxed"]
    rows = rows.sort_values(["relaxed", "fresh", "global_rank"]).head(k)
    reason = np.select([rows["relaxed"], ~rows["fresh"]], ["industry_cap_relaxed", "buffer_keep"], "new_top_rank")
    return rows.assign(selection_reason=reason, candidate_position=np.arange(1, len(rows) + 1))


def chained_top_k(ranked: DataFrame, config: SelectionConfig) -> DataFrame:
    """constrained_top_k of every period (a column), each with the codes of the
    basket before it: rows with candidate_position and selection_reason added.

    Only this chain runs in order, so only contenders come to the driver: codes,
    industries and ranks, a number of rows that top_k and the periods bound. Keys
    (period, code) are unique."""
    thin = contenders(ranked, config).select("period", "code", "industry", "global_rank").toPandas()
    baskets, held = [], ()
    for _, rows in thin.groupby("period", sort=True):
        baskets.append(_basket(rows, held, config))
        held = baskets[-1]["code"]
    columns = ["period", "code", "candidate_position", "selection_reason"]
    found = [r for b in baskets for r in zip(*(b[c].tolist() for c in columns), strict=True)]
    chosen = ranked.sparkSession.createDataFrame(found, "period int, code string, candidate_position int, selection_reason string")
    return ranked.join(F.broadcast(chosen), ["period", "code"])


def as_of_index(frame: DataFrame, as_of: str | None = None) -> tuple[str, int]:
    """(date, date_idx) of the last date of the data up to as_of."""
    days = frame.where(F.col("date") <= F.lit(as_of).cast("date")) if as_of else frame
    row = days.agg(F.max(F.struct("date_idx", "date")).alias("last")).first()["last"]
    if row is None:
        raise ValueError(f"no date of the data is on or before {as_of}" if as_of else "the data has no dates")
    return row["date"].isoformat(), row["date_idx"]
