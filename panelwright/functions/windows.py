"""Window functions of a panel: along an entity's rows, across a date's entities.

All functions along an entity share one window (partitioned by code, ordered by
date_idx), so that any number of them costs one exchange and one sort; those
across entities share the exchange by date.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add, and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scalars import TINY

def by_code():  # noqa: ANN201
    """Along an entity's own rows (made when a session exists)."""
    return W.partitionBy("code").orderBy("date_idx")

_AGGREGATES = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max, "sum": F.sum}


def date_keys(df: DataFrame) -> tuple[str, ...]:
    """What rows of one date are alike in: date_idx too, where there is one, so
    that a range of it is filtered before the windows, not after."""
    return ("date", "date_idx") if "date_idx" in df.columns else ("date",)


def dealt_by_date(df: DataFrame) -> DataFrame:
    """df dealt out for windows by date_keys: dates in turn, so that a task gets
    one date (or the fewest possible), where hashing deals some tasks several
    times as many; what a task sorts and holds is a date's rows."""
    if "date_idx" not in df.columns:
        return df
    return df.repartitionById(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("date_idx"))


def lag(x: Column, n: int) -> Column:
    return F.lag(x, n).over(by_code())


def rolling(x: Column, n: int, kind: str) -> Column:
    """Of the last n rows, NULL unless all n have a value; std is the population's."""
    frame = by_code().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, _AGGREGATES[kind](x).over(frame))


def delta(x: Column, n: int) -> Column:
    return x - lag(x, n)


def growth(x: Column, n: int = 1) -> Column:
    """x over its value n rows before, less 1."""
    return F.try_divide(x, lag(x, n)) - 1.0


def guarded_growth(x: Column, n: int) -> Column:
    """growth, NULL where the earlier value is within TINY of 0."""
    before = lag(x, n)
    return F.when(F.abs(before) > TINY, F.try_divide(x, before)) - 1.0


def zscore(x: Column, n: int) -> Column:
    return zscore_of(x, rolling(x, n, "mean"), rolling(x, n, "std"))


def zscore_of(x: Column, mean: Column, spread: Column) -> Column:
    return F.when(spread > TINY, F.try_divide(x - mean, spread))


def ahead(x: Column, steps: int) -> Column:
    """x of the row of the same code exactly `steps` dates ahead in the calendar,
    NULL if it has none: a RANGE frame of one point, and so no join."""
    return F.first(x).over(by_code().rangeBetween(steps, steps))


def percentile_rank(x: Column, *by: str) -> Column:
    """Average rank over the number of values among rows alike in `by`, less
    one half; NULL stays NULL. One sort per ranked column."""
    order = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    average = (F.rank().over(order) + upto) / F.lit(2)
    return F.when(x.isNotNull(), average / F.count(x).over(W.partitionBy(*by)) - 0.5)


def average_rank(x: Column, *by: str) -> Column:
    order = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    upto = F.count(x).over(order.rangeBetween(W.unboundedPreceding, W.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(order) + upto) / F.lit(2))


Part = tuple[int, tuple[str, ...]]


def _put_together(df: DataFrame, made: dict[str, tuple[str, Sequence[Part]]]) -> DataFrame:
    """df with {name: (kind, (rows, columns) of windows that follow one another)} as one
    window each, NULL if any row's value is. For std: the mean, and `squares`, the sum
    of squared deviations; of equal values it is 0, since means are taken apart first."""
    shifts: dict[str, Column] = {}
    out: dict[str, Column] = {}
    for name, (kind, parts) in made.items():
        values = [F.col(columns[0]) for _, columns in parts]
        if kind == "std":
            apart = [(float(k), x - values[-1]) for (k, _), x in zip(parts, values, strict=True)]
            shifts[f"{name} shift"] = reduce(add, (x * k for k, x in apart)) / float(sum(k for k, _ in parts))
            shift = F.col(f"{name} shift")
            squares = [(x - shift) * (x - shift) * k for k, x in apart] + [F.col(c) for _, columns in parts for c in columns[1:]]
            out |= {name: values[-1] + shift, f"{name} squares": reduce(add, squares)}
        elif kind == "sum" or len(values) == 1:
            out[name] = reduce(add, values)
        else:
            out[name] = F.when(reduce(and_, (x.isNotNull() for x in values)), (F.least if kind == "min" else F.greatest)(*values))
    return df.withColumns(shifts).withColumns(out)


def with_rolling(df: DataFrame, columns: dict[str, tuple[str, int, str]]) -> DataFrame:
    """df with {name: rolling(column, n, kind)}, all of them in two steps: windows of a
    few rows, the base, from earlier rows, then those of n rows from such windows and
    what n leaves over. Earlier rows are cheap to look up, while a frame is gone over
    anew for every row. The base is the one that asks for the fewest."""
    if not columns:
        return df
    keep = [c for c in df.columns if c not in columns]
    held = {name: (x, n, "sum" if kind == "mean" else kind) for name, (x, n, kind) in columns.items()}
    wanted = sorted(set(held.values()))
    bases = sorted({(x, kind) for x, n, kind in wanted if kind != "sum"})
    base = min(range(2, 33), key=lambda b: len(bases) * b + sum(sum(divmod(n, b)) for _, n, kind in wanted if kind != "sum"))

    def steps(df: DataFrame, made: dict[str, tuple[str, list[tuple[int, tuple[str, ...], int]]]]) -> DataFrame:
        """made: (kind, (rows, columns, how many rows before) of each part, oldest first)."""
        at = lambda c, n: f"{c} {n} before" if n else c
        moved = {at(c, n): lag(F.col(c), n) for _, parts in made.values() for _, of, n in parts for c in of if n}
        return _put_together(df.withColumns(moved) if moved else df, {k: (kind, [(rows, tuple(at(c, n) for c in of)) for rows, of, n in parts]) for k, (kind, parts) in made.items()})

    row = lambda x, kind: f"{x} as a double" if kind in ("sum", "std") else x
    of = lambda x, kind, what: f"{x} {kind} {what}"
    both = lambda name, kind: (name, f"{name} squares") if kind == "std" else (name,)
    df = df.withColumns({row(x, kind): F.col(x).cast("double") for x, _, kind in wanted if kind in ("sum", "std")})
    backwards = lambda n, x, kind, after: [(1, (row(x, kind),), i) for i in range(after + n - 1, after - 1, -1)]
    small = {of(x, kind, "base"): (kind, backwards(base, x, kind, 0)) for x, kind in bases if any(n >= base for y, n, k in wanted if (y, k) == (x, kind))}
    small |= {of(x, kind, f"rest of {n}"): (kind, backwards(n % base, x, kind, n - n % base)) for x, n, kind in wanted if n % base and kind != "sum"}
    # sums are added row by row, oldest first, as a frame adds them: their last bits decide how halves are rounded
    small |= {of(x, kind, n): (kind, backwards(n, x, kind, 0)) for x, n, kind in wanted if kind == "sum"}
    df = steps(df, small)
    whole = {}
    for x, n, kind in (w for w in wanted if w[2] != "sum"):
        parts = [(n % base, both(of(x, kind, f"rest of {n}"), kind), 0)] if n % base else []
        parts += [(base, both(of(x, kind, "base"), kind), i * base) for i in range(n // base - 1, -1, -1)]
        whole[of(x, kind, n)] = (kind, parts)
    df = steps(df, whole)

    def value(name: str) -> Column:
        x, n, kind = held[name]
        if kind == "std":
            return F.sqrt(F.col(f"{of(x, kind, n)} squares") / float(n))
        return F.col(of(x, kind, n)) / float(n) if columns[name][2] == "mean" else F.col(of(x, kind, n))

    return df.select(*keep, *(value(name).alias(name) for name in columns))


def with_ema(df: DataFrame, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """df with exponential means {name: (column, span)} along each code: carried
    over gaps (whose weight decays), NULL until `span` values were seen. The
    recurrence has no window form, so the averaged columns (and no others) pass
    through pandas, in the order in which the row number below leaves them; a
    batch's last code waits for the rest of its rows (one per date, hence bounded
    by the calendar)."""
    if not columns:
        return df
    spans = [(f"y{i}", n) for i, (_, n) in enumerate(columns.values())]

    def means(rows: pd.DataFrame) -> pd.DataFrame:
        by = rows.groupby(np.cumsum(rows["at"].to_numpy() == 1))
        return pd.DataFrame({y: by[y].ewm(span=n, min_periods=n, adjust=False).mean().to_numpy() for y, n in spans})

    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        held = None
        for at, *values in batches:
            rows = pd.DataFrame({"at": at.to_numpy()} | {y: x.to_numpy(dtype=float) for (y, _), x in zip(spans, values, strict=True)})
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = np.flatnonzero(rows["at"].to_numpy() == 1)[-1]
            if last:
                yield means(rows[:last])
            held = rows[last:]
        if held is not None:
            yield means(held)

    # not deterministic as far as plans go: what it returns depends on the order of rows, which must stay
    made = F.pandas_udf(of, StructType([StructField(y, DoubleType()) for y, _ in spans])).asNondeterministic()
    numbered = df.withColumn("row of code", F.row_number().over(by_code()))
    found = numbered.withColumn("means", made("row of code", *(F.col(x).cast("double") for x, _ in columns.values())))
    return found.select(*(c for c in df.columns if c not in columns), *(F.col(f"means.{y}").alias(name) for name, (y, _) in zip(columns, spans, strict=True)))
