"""Quality rules whose thresholds follow each language and source.

Every document's measures are native expressions over its own row. Mergeable
quantile sketches (KLL) of the measures are built for every language and source
in one aggregation: partial sketches are made before the shuffle, so a source
that holds a third of all rows sends a few kilobytes from each task. Fences
from the sketches' quantiles replace fixed cutoffs, and a join on the two keys
applies them. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACES, WORD_SPLIT, stage, table, text_of

SYMBOLS = "#*$%&|<>"

#: (measure, the side on which a document fails, the upper quantile q, how many times the distance
#: from quantile 1 - q to q a fence lies beyond q, its least distance from the median). Most documents
#: repeat nothing, so that the quartiles of repeated lines and windows tell nothing.
MEASURES = (
    ("word_length", "both", 0.75, 3.0, 1.0),
    ("symbol_share", "high", 0.75, 3.0, 0.05),
    ("dup_line_share", "high", 0.97, 1.5, 0.15),
    ("repeat_share", "high", 0.97, 1.5, 0.1),
)
#: Values that a sketch holds exactly, before it begins to halve them.
SKETCH_K = 4096


def _without(text: Column, chars: str) -> Column:
    """How many characters of text are none of chars."""
    total = F.char_length(text)
    return total - sum((total - F.char_length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def _equal_to_neighbour(sorted_items: str, same: str) -> str:
    """SQL: for each item of a sorted array, whether `same` holds for it and the
    item before (a) or after (b) it."""
    pairs = f"zip_with(slice({sorted_items}, 1, greatest(size({sorted_items}) - 1, 0)), slice({sorted_items}, 2, greatest(size({sorted_items}) - 1, 0)), (a, b) -> {same})"
    return f"zip_with(concat(array(false), {pairs}), concat({pairs}, array(false)), (p, q) -> p OR q)"


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row of docs: n_words,
    word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, all long.

    Three-word windows are hashed; hash and position share one long whose low
    bits hold the position, so that one sort of plain longs brings equal windows
    together. Windows whose hashes meet are then compared as whole strings, so
    the count is exact. Null text counts as empty; lang and source may be null.
    """
    t = docs.select("doc_id", "lang", "source", text_of().alias("text"))
    t = t.select(
        "doc_id",
        "lang",
        "source",
        _without(F.col("text"), SPACES).cast("long").alias("word_chars"),
        (F.char_length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        F.split(F.btrim("text", F.lit(SPACES)), WORD_SPLIT).alias("words"),
    )
    t = t.select(
        "doc_id",
        "lang",
        "source",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("word_chars") == 0, 0).otherwise(F.size("words")).cast("long").alias("n_words"),
        "words",
        F.expr("cast(ceil(log2(size(words) + 2)) AS int)").alias("bits"),
        F.expr(
            "slice(zip_with(zip_with(words, slice(words, 2, size(words)), (a, b) -> struct(a, b)), slice(words, 3, size(words)),"
            " (p, c) -> xxhash64(p.a, p.b, c)), 1, greatest(size(words) - 2, 0))"
        ).alias("hashes"),
    )
    counts = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    t = t.select(*counts, "words", "bits", F.expr("sort_array(transform(hashes, (h, i) -> shiftleft(h, bits) | i))").alias("keys"))
    t = t.select(*counts, "words", "bits", "keys", F.expr(_equal_to_neighbour("keys", "shiftrightunsigned(a, bits) = shiftrightunsigned(b, bits)")).alias("met"))
    t = t.select(*counts, "words", F.expr("transform(filter(zip_with(keys, met, (k, m) -> if(m, k, null)), k -> k IS NOT NULL), k -> cast(k & (shiftleft(1L, bits) - 1) AS int))").alias("at"))
    t = t.select(
        *counts,
        F.expr("sort_array(transform(at, i -> struct(concat_ws(' ', get(words, i), get(words, i + 1), get(words, i + 2)) AS w, i AS i)))").alias("windows"),
    )
    t = t.select(*counts, "windows", F.expr(_equal_to_neighbour("windows", "a.w = b.w")).alias("met"))
    t = t.select(*counts, F.expr("sort_array(filter(zip_with(windows, met, (k, m) -> if(m, k.i, null)), k -> k IS NOT NULL))").alias("at"))
    steps = "zip_with(slice(at, 1, greatest(size(at) - 1, 0)), slice(at, 2, greatest(size(at) - 1, 0)), (a, b) -> least(b - a, 3))"
    return t.select(*counts, F.expr(f"cast(if(size(at) = 0, 0, aggregate({steps}, 0, (s, x) -> s + x) + 3) AS long)").alias("n_repeat_words"))


def with_shares(counts: DataFrame) -> DataFrame:
    """The measures that thresholds are learnt for, and base_failed."""
    n = F.col("n_words").cast("double")
    return counts.select(
        "*",
        F.try_divide(F.col("word_chars").cast("double"), n).alias("word_length"),
        F.try_divide(F.col("n_symbols").cast("double"), n).alias("symbol_share"),
        F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double")).alias("dup_line_share"),
        F.try_divide(F.col("n_repeat_words").cast("double"), n).alias("repeat_share"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def fences(shares: DataFrame) -> DataFrame:
    """A row for each (lang, source): low_ and high_ of every measure, from the
    sketches of the documents that pass the base rules; null keys form a group.

    A fence lies beyond a quantile by a multiple of the distance between the
    quantiles (see MEASURES), but never nearer to the median than a least
    distance, so that a measure which hardly varies has a fence all the same."""
    sketched = (
        shares.where("NOT base_failed")
        .groupBy("lang", "source")
        .agg(*(F.kll_sketch_agg_double(name, F.lit(SKETCH_K)).alias(name) for name, *_ in MEASURES))
    )

    def at(name: str, q: float) -> Column:
        return F.kll_sketch_get_quantile_double(name, F.lit(q))

    columns = []
    for name, _, q, reach, least in MEASURES:
        low, high = at(name, round(1 - q, 6)), at(name, q)
        columns.append(F.least(low - reach * (high - low), at(name, 0.5) - least).alias(f"low_{name}"))
        columns.append(F.greatest(high + reach * (high - low), at(name, 0.5) + least).alias(f"high_{name}"))
    return sketched.select("lang", "source", *columns)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, the rules that failed (rules: array) and kept, for
    every row of docs(doc_id, text, lang, source).

    Null or empty text fails the base rules. A null lang or source is a value of
    its own; null ids and repeated rows are documents of their own, and count as
    often as they occur. A value equal to its fence passes. A group without a
    document that passes the base rules has no fences, and nothing left to
    judge. No rows: no rows. Texts are read whole, whatever their length.

    Up to SKETCH_K documents of a group the quantiles are exact. Beyond, a
    sketch's ranks are off by about 0.1 %, and since it drops values by chance
    and is merged in the order of arrival, the fences of such a group may differ
    by that much from run to run."""
    shares = stage(with_shares(measured(docs)), "measures")
    limits = stage(fences(shares), "fences").select(F.col("lang").alias("l_"), F.col("source").alias("s_"), *[f"{s}_{n}" for n, *_ in MEASURES for s in ("low", "high")])
    joined = shares.join(limits, F.col("lang").eqNullSafe(F.col("l_")) & F.col("source").eqNullSafe(F.col("s_")), "left")
    failed = []
    for name, side, *_ in MEASURES:
        if side == "both":
            failed.append(F.when(F.col(name) < F.col(f"low_{name}"), f"{name}_low"))
        failed.append(F.when(F.col(name) > F.col(f"high_{name}"), f"{name}_high"))
    rules = F.array_compact(F.array(*failed))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size(rules) == 0)).alias("kept"), rules.alias("rules"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _limits(n: str, q: float, reach: float, least: float) -> str:
    low, high = f"quantile_disc({n}, {round(1 - q, 6)})", f"quantile_disc({n}, {q})"
    wide = f"{reach} * ({high} - {low})"
    return f"least({low} - {wide}, quantile_disc({n}, 0.5) - {least}) AS low_{n}, greatest({high} + {wide}, quantile_disc({n}, 0.5) + {least}) AS high_{n}"


_LIMITS = ",\n".join(_limits(n, *rest) for n, _, *rest in MEASURES)
_FAILS = ", ".join(
    f"CASE WHEN {n} {sign} {end}_{n} THEN '{n}_{end}' END" for n, side, *_ in MEASURES for end, sign in (("low", "<"), ("high", ">")) if side in (end, "both")
)

#: Exact where every group has at most SKETCH_K documents.
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
pos AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, lang, source, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, dup.lines AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
    FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
s AS (SELECT *, word_chars / nullif(n_words, 0) AS word_length, n_symbols / nullif(n_words, 0) AS symbol_share, n_dup_lines / n_lines AS dup_line_share,
    n_repeat_words / nullif(n_words, 0) AS repeat_share, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (SELECT lang, source, {_LIMITS} FROM s WHERE NOT base_failed GROUP BY lang, source),
r AS (SELECT s.*, list_filter([{_FAILS}], lambda x: x IS NOT NULL) AS rules FROM s LEFT JOIN f ON s.lang IS NOT DISTINCT FROM f.lang AND s.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(rules) = 0 AS kept, rules FROM r
"""
