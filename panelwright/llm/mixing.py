"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. In a phase a source has the exact
weight w (a fraction, never rounded); its k-th block is released at floor(k / w)
and due at ceil((k + 1) / w). Slots go to the released block with the earliest
deadline, which meets every deadline, so that at each time of a phase, however
long, a source has had less than one block more or less than its share.

What each source has had tells all of the schedule's state. The driver follows
the schedule (a step for each block) and notes that state at the beginning of
every round; executors deal the rounds again from there. So the driver holds a
number for each source and round, and never the blocks' places.

A phase ends with the last block of a source; then a new one begins, in which
the sources that are left share its weight. Every document is used exactly once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, replace
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import partitions, table

#: Documents in a block: the driver takes a step for each, so ten billion documents take it some minutes.
BLOCK = 128
#: Slots in a round: what one task deals at a time.
ROUND = 8192


def edf(weights: Mapping[str, int], had: Mapping[str, int], slot: int, end: int) -> Iterator[tuple[str, int]]:
    """(source, number) of the block in each slot from `slot` to `end`, after
    `had` blocks of each source. A source's share is its part of all weights."""
    total = sum(weights.values())
    wait = [(had.get(s, 0) * total // w, -(-(had.get(s, 0) + 1) * total // w), s, had.get(s, 0)) for s, w in sorted(weights.items())]
    heapq.heapify(wait)
    ready: list[tuple[int, str, int]] = []
    for now in range(slot, end):
        while wait and wait[0][0] <= now:
            _, due, s, k = heapq.heappop(wait)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        if due <= now:
            raise AssertionError("a deadline is missed")
        yield s, k
        heapq.heappush(wait, ((k + 1) * total // weights[s], -(-(k + 2) * total // weights[s]), s, k + 1))


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of the weights, which must be
    positive and finite."""
    if not all(0 < w < math.inf for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    found = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in found.values()))
    return {s: int(x * unit) for s, x in found.items()}


@dataclass(frozen=True)
class Phase:
    """Blocks `first[s]` to `first[s] + count[s]` of each source s, dealt from
    position `begin` on by exact weights; `had` holds what each source has had
    at the beginning of every `slots` slots."""

    begin: int
    weights: dict[str, int]
    first: dict[str, int]
    count: dict[str, int]
    slots: int
    had: list[dict[str, int]]

    @property
    def size(self) -> int:
        return sum(self.count.values())

    def dealt(self, r: int, had: Mapping[str, int]) -> list[tuple[str, int]]:
        """(source, block) in each slot of round r, which begins after `had` blocks."""
        return [(s, self.first[s] + k) for s, k in edf(self.weights, had, r * self.slots, min(self.size, (r + 1) * self.slots))]


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], slots: int = ROUND) -> list[Phase]:
    """The phases of a mix: as many as there are sources, at most."""
    left, done, out, begin = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0), [], 0
    while left:
        part = exact({s: weights[s] for s in left})
        count, had = dict.fromkeys(left, 0), []
        for slot, (s, _) in enumerate(edf(part, {}, 0, sum(left.values()))):
            if slot % slots == 0:
                had.append(dict(count))
            count[s] += 1
            if count[s] == left[s]:
                break
        out.append(Phase(begin, part, {s: done[s] for s in left}, count, slots, had))
        begin += sum(count.values())
        for s, n in count.items():
            done[s] += n
        left = {s: n - count[s] for s, n in left.items() if n > count[s]}
    return out


def _dealt(spark: SparkSession, plan: list[Phase]) -> DataFrame:
    """s, block, phase, slot of every block, dealt by executors round by round."""
    rounds = [(i, r, list(had.items())) for i, p in enumerate(plan) for r, had in enumerate(p.had)]
    # a number or two for each source and phase
    lean = spark.sparkContext.broadcast([replace(p, had=[]) for p in plan])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, r, had in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                part = lean.value[i]
                found = part.dealt(r, {x["s"]: x["n"] for x in had})
                begin = part.begin + r * part.slots
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _ in found], pa.string()),
                        pa.array([k for _, k in found], pa.int64()),
                        pa.array([i] * len(found), pa.int32()),
                        pa.array(range(begin, begin + len(found)), pa.int64()),
                    ],
                    ["s", "block", "phase", "slot"],
                )

    made = spark.createDataFrame(rounds, "phase int, round int, had array<struct<s: string, n: long>>")
    return made.mapInArrow(of, "s string, block long, phase int, slot long")


def _own(columns: list[str]) -> Callable[[str], str]:
    """Makes names that none of the columns has."""
    tag = "of mix"
    while any(c.lower().endswith(tag) for c in columns):
        tag += "_"
    return lambda name: f"{name} {tag}"


def numbered(docs: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """docs with the column `name`: 0, 1, 2, ... within each key (not null), in
    the order of a hash of `order` (of the whole row where that is null). A
    source is cut into buckets by the hash's first bits, so that no task numbers
    all rows of a source: rows are numbered within their bucket, and buckets are
    offset by a running sum over their counts."""
    columns = docs.columns
    own = _own(columns)
    hashed, bucket, n, before, of_key, of_bucket, rank = (own(x) for x in ("hash", "bucket", "n", "before", "key", "at", "rank"))
    bits = max(64, 4 * partitions(docs.sparkSession)).bit_length()
    whole = F.xxhash64(*(F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
    rows = docs.withColumn(hashed, F.when(F.col(order).isNull(), whole).otherwise(F.xxhash64(order)))
    rows = rows.withColumn(bucket, F.shiftright(hashed, 64 - bits))
    counts = rows.groupBy(key, bucket).agg(F.count("*").alias(n))
    running = F.sum(n).over(W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(F.col(key).alias(of_key), F.col(bucket).alias(of_bucket), F.coalesce(running, F.lit(0)).alias(before))
    within = W.partitionBy(key, bucket).orderBy(hashed, order)
    ranked = rows.withColumn(rank, F.row_number().over(within) - 1)
    # by the very columns that the window is partitioned by: rows move once
    joined = ranked.join(offsets, (F.col(key) == F.col(of_key)) & (F.col(bucket) == F.col(of_bucket)))
    return joined.select(*(F.col(f"`{c}`") for c in columns), (F.col(rank) + F.col(before)).cast("long").alias(name))


MIX_COLUMNS = ("mix_block", "mix_phase", "mix_slot", "mix_position")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, slots: int = ROUND) -> DataFrame:
    """docs (doc_id, source, and whatever else) with the columns mix_block (the
    number of the block within its source), mix_phase, mix_slot (its slot) and
    mix_position (the order of documents; the last block of a source may be short
    and leave a gap). Columns of docs with these names are replaced; all others
    are kept, whatever their names.

    weights: of each source, by its name, positive; those not named, and all by
    default, get the square root of their number of documents, so that large
    sources are damped. A null source is a source of its own, named ''. Every
    row is used once: repeated rows and null ids too (rows that agree in all
    columns are interchangeable). Sources of equal deadlines go by their names.
    No rows: no rows.

    The driver holds a number for each source and round of `slots` slots.
    """
    spark = docs.sparkSession
    docs = docs.drop(*(c for c in docs.columns if c.lower() in MIX_COLUMNS))
    own = _own(docs.columns)
    source, place, number = own("source"), own("place"), own("number")
    named = docs.withColumn(source, F.coalesce(F.col("source").cast("string"), F.lit("")))
    sizes = {r[0]: r[1] for r in named.groupBy(source).agg(F.count("*")).collect()}
    given = weights or {}
    plan = phases({s: -(-n // block) for s, n in sizes.items()}, {s: given.get(s, n**0.5) for s, n in sizes.items()}, slots)
    dealt = _dealt(spark, plan).select(*(F.col(c).alias(own(f"dealt {c}")) for c in ("s", "block", "phase", "slot")))
    blocks = numbered(named, source, "doc_id", place).withColumn(number, F.floor(F.col(place) / block))
    placed = blocks.join(dealt, (F.col(source) == F.col(own("dealt s"))) & (F.col(number) == F.col(own("dealt block"))))
    slot = F.col(own("dealt slot"))
    return placed.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.col(number).alias("mix_block"),
        F.col(own("dealt phase")).alias("mix_phase"),
        slot.alias("mix_slot"),
        (slot * block + F.col(place) % block).alias("mix_position"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix by damped weights."""
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its place in the mix."""
    return mix(docs)
