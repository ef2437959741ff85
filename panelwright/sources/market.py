"""Market panels: CSV or any frame in, one validated canonical frame out."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..config import AppConfig, DataConfig
from ..functions.scalars import number

PRICES = ("open", "high", "low", "close")
REQUIRED = (*PRICES, "volume", "amount")
NUMERIC_OPTIONAL = ("adj_factor", "market_cap", "turnover_rate", "listing_days")
FLAGS = ("is_st", "is_suspended", "is_limit_up", "is_limit_down")

# Tokens of a missing cell (as they are written), and of true and false, in lower case.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE = ("1", "true", "t", "yes", "y", "是")
FALSE = ("0", "false", "f", "no", "n", "否", "", "<na>")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, missing tokens as NULL; types come later."""
    if "://" not in str(path) and not Path(path).exists():
        raise FileNotFoundError(f"no input at {path}")
    raw = spark.read.option("header", True).option("multiLine", False).csv(str(path))
    return raw.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in raw.columns))


def parsed_date(x: Column) -> Column:
    """yyyy-MM-dd (with or without a time) or yyyyMMdd, else NULL."""
    text = F.trim(x.cast("string"))
    return F.coalesce(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"), F.when(text.rlike("^[0-9]{8}$"), F.try_to_date(text, "yyyyMMdd")))


# Forms of dates, beside those that parsed_date reads. Days and months may lack a zero; a time may follow.
DATE_FORMS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "d MMM yyyy", "MMM d yyyy")
ISO = "yyyy-MM-dd or yyyyMMdd"


def date_in(x: Column, form: str) -> Column:
    """x read by one form, else NULL."""
    if form == ISO:
        return parsed_date(x)
    text = F.regexp_replace(F.trim(x.cast("string")), r"[T ]+[0-9]{1,2}:[0-9:.]+Z?$", "")
    return F.try_to_date(text, form)


def date_form(df: DataFrame, column: str) -> str:
    """The one form in which all cells of a column (but NULLs) are dates; one
    aggregation counts what each form reads. ValueError where none reads all, so
    that a column of mixed forms is refused, and where two do, day first and month
    first, and differ in a date."""
    x, forms = F.col(f"`{column}`"), (ISO, *DATE_FORMS)
    read = [date_in(x, form) for form in forms]
    swapped = [(i, forms.index(f"M{f[1]}d{f[3:]}")) for i, f in enumerate(forms) if f.startswith(("d/M", "d-M"))]
    differ = [F.count_if(read[i] != read[j]) for i, j in swapped]
    n, *counts = df.agg(*(c.alias(f"x{i}") for i, c in enumerate((F.count(x), *(F.count(r) for r in read), *differ)))).first()
    whole = [i for i, k in enumerate(counts[: len(forms)]) if k == n]
    if not whole:
        best = max(range(len(forms)), key=counts.__getitem__)
        odd = df.where(x.isNotNull() & read[best].isNull()).select(x).limit(5).collect()
        raise ValueError(f"dates that can't be read: {[r[0] for r in odd]}" + (f" (the others are {forms[best]})" if counts[best] else ""))
    for (i, j), k in zip(swapped, counts[len(forms) :], strict=True):
        if k and {i, j} <= set(whole):
            raise ValueError(f"dates of {column} can be {forms[i]} or {forms[j]}; name the form")
    return forms[whole[0]]


def normal_code(x: Column) -> Column:
    """Trimmed; one to six digits are filled with zeros to six."""
    text = F.trim(x.cast("string"))
    return F.when(text.rlike("^[0-9]{1,6}$"), F.lpad(text, 6, "0")).otherwise(text)


def flag(x: Column, numeric: bool = False) -> Column:
    """A boolean of tokens (NULL if it is none of them), or of numbers: other than 0."""
    text = F.lower(F.trim(x.cast("string")))
    if numeric:
        return F.coalesce(number(text) != 0, F.lit(False))
    return F.when(x.isNull() | text.isin(*FALSE), False).when(text.isin(*TRUE), True)


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    """The keys that occur more than once, with their number n of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def unique_keys(df: DataFrame, *keys: str) -> None:
    """Raises with up to ten keys that occur more than once."""
    if rows := repeated_keys(df, *keys).orderBy(*keys).limit(10).collect():
        raise ValueError(f"duplicate {'/'.join(keys)} rows: {[tuple(r)[:-1] for r in rows]}")


def valid_market_data() -> Column:
    positive = [F.col(c) > 0 for c in PRICES]
    whole = positive[0]
    for x in (*positive[1:], F.col("volume") >= 0, F.col("amount") >= 0):
        whole = whole & x
    return F.coalesce(whole, F.lit(False))


def adjusted(df: DataFrame) -> DataFrame:
    return df.withColumns({f"adj_{c}": F.col(c) * F.col("adj_factor") for c in PRICES})


def with_calendar(df: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """df with date_idx: the date's place among the dates of the data. The
    calendar has one row per date, and so may be broadcast. dates: a column
    `date` with the same dates, where it is cheaper to read than df's."""
    days = (df if dates is None else dates).select("date").distinct().withColumn("date_idx", (F.row_number().over(W.orderBy("date")) - 1).cast("int"))
    return df.join(F.broadcast(days), "date")


def standardise(raw: DataFrame, config: DataConfig | None = None, check: bool = True, date_format: str = ISO) -> DataFrame:
    """The canonical panel of a frame with date, code, open, high, low, close,
    volume, amount and any optional columns; others pass through. check: reject
    bad dates, empty codes and unknown flags (one pass), and duplicate keys. Dates
    that aren't all of date_format are read in the one form that fits them all,
    if check is set (see date_form; a further pass)."""
    names = config or DataConfig()
    if missing := [c for c in (names.date_col, names.code_col, *REQUIRED) if c not in raw.columns]:
        raise ValueError(f"missing columns: {missing}")
    renamed = {names.date_col: "date", names.code_col: "code"} | ({names.industry_col: "industry"} if names.industry_col in raw.columns else {})
    df = raw.withColumnsRenamed(renamed)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    dated = lambda form: df.withColumns({"date": date_in(F.col("date"), form), "code": normal_code(F.col("code"))})
    typed = dated(date_format)
    tokens = [c for c in FLAGS if c in kinds and not isinstance(kinds[c], (BooleanType, NumericType))]
    undated, uncoded = F.col("date").isNull(), F.col("code").isNull() | (F.col("code") == "")
    odd = {c: F.col(c).isNotNull() & number(F.col(c)).isNull() for c in tokens}
    strange = {c: flag(F.col(c)).isNull() for c in tokens}
    numeric = {c for c in FLAGS if c in kinds and isinstance(kinds[c], NumericType)}
    if check:
        # all faults are counted in one pass; examples are fetched only of those there are
        counts = typed.agg(F.count_if(undated), F.count_if(uncoded), *(F.count_if(x[c]) for c in tokens for x in (odd, strange))).first()
        if counts[0]:
            if lacking := df.where(F.col("date").isNull()).limit(5).collect():
                raise ValueError(f"dates that can't be read: {[r['date'] for r in lacking]}")
            typed = dated(date_form(df, "date"))
        if counts[1]:
            raise ValueError(f"rows without a code: {[tuple(r) for r in typed.where(uncoded).select('date', 'code').limit(5).collect()]}")
        unknown = []
        for c, no_number, no_token in zip(tokens, counts[2::2], counts[3::2], strict=True):
            if not no_number:
                numeric.add(c)
            elif no_token:
                unknown += [(c, r[0]) for r in typed.where(strange[c]).select(c).distinct().orderBy(c).limit(10).collect()]
        if unknown:
            raise ValueError(f"flags that are neither true nor false: {unknown}")
    columns: dict[str, Column] = {c: number(F.col(c)) for c in REQUIRED}
    columns |= {c: number(F.col(c)) if c in kinds else F.lit(None).cast("double") for c in NUMERIC_OPTIONAL}
    for c in FLAGS:
        if c not in kinds:
            columns[c] = F.lit(False)
        else:
            columns[c] = F.coalesce(F.col(c) if isinstance(kinds[c], BooleanType) else flag(F.col(c), c in numeric), F.lit(False))
    columns["industry"] = F.coalesce(F.nullif(F.col("industry").cast("string"), F.lit("")), F.lit("UNKNOWN")) if "industry" in kinds else F.lit("UNKNOWN")
    typed = typed.withColumns(columns)
    typed = typed.withColumn("adj_factor", F.coalesce(F.nullif("adj_factor", F.lit(0.0)), F.lit(1.0)))
    if check:
        unique_keys(typed, "date", "code")
    observed = F.row_number().over(W.partitionBy("code").orderBy("date")).cast("double")
    typed = with_calendar(typed).withColumns({"listing_days": F.coalesce("listing_days", observed), "has_valid_market_data": valid_market_data()})
    return adjusted(typed)


def load_market_data(spark: SparkSession, path: str, config: AppConfig) -> DataFrame:
    return standardise(read_csv(spark, path), config.data)


def previous_codes(spark: SparkSession, path: str) -> list[str]:
    """The codes of an earlier basket's CSV (a basket has at most top_k rows)."""
    df = read_csv(spark, path)
    if "code" not in df.columns:
        raise ValueError("the previous basket has no code column")
    return [r[0] for r in df.select("code").na.drop().collect()]
