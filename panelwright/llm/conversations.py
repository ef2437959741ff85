"""Structure repair of conversations by a lazily determinised weighted automaton.

The roles of a sound conversation are `(s?(ua)+)?` by their initials. A row may
be kept, given another role or deleted, and rows may be inserted, each at a
cost. Read from a conversation's end, what is left to pay from each of the four
states is a vector. Less its least element it is one of some dozens: these are
the states of a deterministic automaton, whose transitions are worked out when
they are first met and kept in a table. A scan of the table gives the cost of a
repair; a trace the other way, along moves whose costs are tight, gives the
edits, and among equals those that are first in ASCII order.

No conversation has to fit a task. Rows are numbered by a range partitioning,
and cut into chunks of at most 2**CHUNK_BITS rows. A chunk's effect on vectors is a
matrix of 16 costs, made for all chunks at once; only matrices are chained, then
chunks are traced at once from each state that they may begin in, and only
these states are chained. Texts are joined to the rows that stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._common import SPACES, stage, table

#: Bits of a chunk's rows: chunks have 1,024 different rows at most.
CHUNK_BITS = 10
#: Chunks that a task holds as Python objects at once.
_BATCH = 256
#: More than any cost of a conversation.
NEVER = 1 << 60

#: States: nothing yet, after a system row, after a user's, after an assistant's.
_STATES, _ACCEPT = range(4), (0, 3)
#: By role (s, u, a) the state that follows each state, -1 for none.
_AFTER = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1))
_ROLES = ("s", "u", "a")
_NAMES = ("", "user", "assistant")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    #: On top, for a truncated row that is not deleted.
    truncated: int = 5


class Automaton:
    """The determinised automaton of a repair, read from the end.

    A row's symbol is 0 if it must be deleted, else 1 + 2 * role (s, u, a,
    other) + 1 if it is truncated."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        #: By 9 * state + symbol the state before the row, -1 if not met yet, and the cost taken out.
        self.table: list[int] = []
        self.added: list[int] = []
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.state(self._inserted([0 if q in _ACCEPT else NEVER for q in _STATES]))[0]

    def state(self, vector: Iterable[int]) -> tuple[int, int]:
        """The number of a vector's state, and its least element."""
        vector = tuple(vector)
        least = min(vector)
        key = tuple(min(x - least, NEVER) if x < NEVER else NEVER for x in vector)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
            self.table += [-1] * 9
            self.added += [0] * 9
        return self.number[key], least

    def _inserted(self, vector: list[int]) -> list[int]:
        for _ in _STATES:
            vector = [min([x, *(vector[n] + self.costs.insert for r in (1, 2) if (n := _AFTER[r][q]) >= 0)]) for q, x in enumerate(vector)]
        return vector

    def _arcs(self, q: int, symbol: int) -> Iterator[tuple[str, int, int]]:
        """(edit, state after, cost) of a row, in ASCII order."""
        yield "D", q, self.costs.delete
        if symbol:
            role, cut = divmod(symbol - 1, 2)
            more = cut * self.costs.truncated
            if role < 3 and _AFTER[role][q] >= 0:
                yield "K", _AFTER[role][q], self.costs.keep + more
            for r in (1, 2):
                if _AFTER[r][q] >= 0:
                    yield "R", _AFTER[r][q], self.costs.rerole + more

    def before(self, state: int, symbol: int) -> tuple[int, int]:
        """(the state before a row, what it adds), given the one after it."""
        at = 9 * state + symbol
        if self.table[at] < 0:
            after = self.vectors[state]
            self.table[at], self.added[at] = self.state(self._inserted([min(after[n] + c for _, n, c in self._arcs(q, symbol)) for q in _STATES]))
        return self.table[at], self.added[at]

    def scan(self, state: int, rows: list[tuple[int, int]]) -> tuple[list[int], int]:
        """Of rows (symbol, how often; only 0 more than once) from the last to the
        first: the states before each and the one at the end, and the sum taken out."""
        states, total = [state], 0
        for symbol, often in reversed(rows):
            state, added = self.before(state, symbol)
            # deletions change no vector but one to which nothing was inserted yet, and that once
            total += added + (often - 1) * self.costs.delete
            states.append(state)
        return states[::-1], total

    def move(self, after: int, symbol: int, q: int) -> tuple[str, int]:
        """The first edits in ASCII order among the cheapest, and the state they lead to."""
        if (after, symbol, q) not in self.moves:
            now, added = self.before(after, symbol)
            here, there, edits, to = self.vectors[now], self.vectors[after], "", q
            while True:
                tight = [("I", n) for r in (1, 2) if (n := _AFTER[r][to]) >= 0 and here[to] == here[n] + self.costs.insert]
                tight += [(edit, n) for edit, n, c in self._arcs(to, symbol) if here[to] + added == there[n] + c]
                edit, to = min(tight)
                edits += edit
                if edit != "I":
                    break
            self.moves[after, symbol, q] = edits, to
        return self.moves[after, symbol, q]

    def trace(self, states: list[int], rows: list[tuple[int, int]], q: int, last: bool) -> tuple[str, int]:
        """The edits of rows from state q, and the state they lead to."""
        edits = []
        for after, (symbol, often) in zip(states[1:], rows, strict=True):
            if symbol:
                done, q = self.move(after, symbol, q)
                edits.append(done)
            else:  # its deletion is tight, and nothing comes before it
                edits.append("D" * often)
        if last:
            vector = self.vectors[self.end]
            while vector[q]:
                q = next(n for r in (1, 2) if (n := _AFTER[r][q]) >= 0 and vector[q] == vector[n] + self.costs.insert)
                edits.append("I")
        return "".join(edits), q


@cache
def automaton(costs: Costs) -> Automaton:
    return Automaton(costs)


def _rows(symbols: list[int], counts: list[int]) -> list[tuple[int, int]]:
    """Rows that repeat at once: the first one's symbol, then deletions."""
    out = []
    for symbol, n in zip(symbols, counts, strict=True):
        if symbol:
            out.append((symbol, 1))
            n -= 1
        if n:
            out.append((0, n))
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """Different rows (conv_id, turn, role, text; the text by its SHA-256) with
    how often each occurs, whether it is blank or truncated, and a place: its
    number in the order of all rows by conversation, turn (nulls first), role,
    text. Equal rows are counted before the shuffle, and a range partitioning
    makes the order, so neither a row that repeats nor a long conversation
    is one task's. Written to the shared folder: places stay as they are."""
    body = F.rtrim("text", F.lit(SPACES))
    keyed = rows.select(
        _at(), (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut")
    )
    runs = keyed.groupBy("at").agg(F.count("*").alias("n"), F.any_value("blank").alias("blank"), F.any_value("cut").alias("cut"))
    order = [f"at.{c}" for c in ("conv_id", "turn", "role", "key")]
    placed = runs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return stage(placed, "conversation_rows")


def _at() -> Column:
    return F.struct("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("key")).alias("at")


def chunks(placed: DataFrame) -> DataFrame:
    """A row for each chunk: conv_id, first (its first place), the symbols, roles
    and counts of its rows in order, and its faults."""
    said = placed.where(~F.col("blank")).groupBy("at.conv_id", "at.role", "at.key").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("new"))
    c = F.col
    initial = F.substring("at.role", 1, 1)
    role = F.coalesce(*(F.when(initial == r, i) for i, r in enumerate(_ROLES)), F.lit(3))
    known = placed.join(said, "place", "left").select("place", c("at.conv_id").alias("conv_id"), "n", "blank", c("new").isNotNull().alias("new"), "cut", role.alias("role"))
    symbol = F.when(c("new"), 1 + 2 * c("role") + c("cut").cast("int")).otherwise(0)
    row = F.struct("place", symbol.alias("symbol"), "role", "n")
    return (
        known.groupBy("conv_id", F.shiftright("place", CHUNK_BITS).alias("chunk"))
        .agg(
            F.min("place").alias("first"), F.sort_array(F.collect_list(row)).alias("rows"), F.sum(F.when(c("blank"), c("n")).otherwise(0)).alias("blank"),
            F.sum(F.when(c("blank"), 0).otherwise(c("n") - c("new").cast("int"))).alias("duplicate"), F.count_if(c("new") & c("cut")).alias("truncated"),
        )
        .select("conv_id", "first", *(c(f"rows.{x}").alias(a) for x, a in (("symbol", "symbols"), ("role", "roles"), ("n", "counts"))), "blank", "duplicate", "truncated")
    )


def _mapped(df: DataFrame, of, more: str, *dropped: str) -> DataFrame:  # noqa: ANN001
    """df without the dropped columns and with those that of adds to its rows:
    it takes an iterator of dicts and gives one."""
    schema = StructType(df.drop(*dropped).schema.fields + StructType.fromDDL(more).fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types, held = to_arrow_schema(schema), []
        for row in of(r for batch in batches for i in range(0, batch.num_rows, _BATCH) for r in batch.slice(i, _BATCH).to_pylist()):
            held.append({k: row[k] for k in names})
            if len(held) == _BATCH:
                yield pa.RecordBatch.from_pylist(held, types)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, types)

    return df.mapInArrow(run, schema)


def _chained(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def edits(found: DataFrame, costs: Costs) -> DataFrame:
    """Chunks with the edits of the cheapest repair: begin (the state before the
    first one), audit, cost (what is left to pay from there) and illegal."""

    def matrix(rows: Iterator[dict]) -> Iterator[dict]:
        machine = automaton(costs)
        for row in rows:
            held, cells = _rows(row["symbols"], row["counts"]), [NEVER] * 16
            for q in _STATES:
                states, total = machine.scan(machine.state(0 if x == q else NEVER for x in _STATES)[0], held)
                cells[q::4] = [min(x + total, NEVER) for x in machine.vectors[states[0]]]
            pairs = zip(row["roles"], row["roles"][1:], strict=False)
            inside = sum(row["counts"]) - len(row["counts"]) + sum(pair not in _LEGAL for pair in pairs)  # equal roles never follow each other
            yield row | {"cells": cells, "inside": inside}

    def backward(rows: Iterator[dict]) -> Iterator[dict]:
        machine, before = automaton(costs), None
        for row in rows:
            last = before is None or before["conv_id"] != row["conv_id"]
            vector = list(machine.vectors[machine.end]) if last else before["vector"]
            cells = row["cells"]
            row["vector"] = [min(min(cells[4 * q + n] + vector[n], NEVER) for n in _STATES) for q in _STATES]
            broken = not last and (row["roles"][-1], before["roles"][0]) not in _LEGAL
            yield row | {"last": last, "end": vector, "cost": row["vector"][0], "illegal": row["inside"] + broken}
            before = row

    def traced(rows: Iterator[dict]) -> Iterator[dict]:
        machine = automaton(costs)
        for row in rows:
            held = _rows(row["symbols"], row["counts"])
            states, _ = machine.scan(machine.state(row["end"])[0], held)
            ways = [machine.trace(states, held, q, row["last"]) if machine.vectors[states[0]][q] < NEVER else ("", q) for q in _STATES]
            yield row | {"audits": [a for a, _ in ways], "ends": [q for _, q in ways]}

    def forward(rows: Iterator[dict]) -> Iterator[dict]:
        conv, q = object(), 0
        for row in rows:
            q = q if row["conv_id"] == conv else 0
            conv = row["conv_id"]
            yield row | {"begin": q, "audit": row["audits"][q]}
            q = row["ends"][q]

    first = F.col("first")
    out = _mapped(found, matrix, "cells array<bigint>, inside bigint")
    out = _mapped(_chained(out, first.desc()), backward, "last boolean, end array<bigint>, cost bigint, illegal bigint", "cells", "inside")
    out = _mapped(out.repartition("conv_id", "first"), traced, "audits array<string>, ends array<int>", "symbols", "end", "last")
    return _mapped(_chained(out, first), forward, "begin int, audit string", "audits", "ends")


def _staying(rows: Iterator[dict]) -> Iterator[dict]:
    """Of each chunk the rows that its edits leave: their number, edit, place
    (null for new ones) and role (null for their own)."""
    for row in rows:
        q, at, used, number = row["begin"], 0, 0, 0
        roles, counts = row["roles"], row["counts"]
        for edit in row["audit"]:
            if edit != "D":
                number += 1
                kept = roles[at] if edit == "K" else 1 if _AFTER[1][q] >= 0 else 2
                yield row | {"number": number, "edit": edit, "place": None if edit == "I" else row["first"] + at, "role": None if edit == "K" else _NAMES[kept]}
                q = _AFTER[kept][q]
            if edit != "I":
                used += 1
                if used == counts[at]:
                    at, used = at + 1, 0


@dataclass(frozen=True)
class Repaired:
    """chunks: conv_id, first, counts, faults, cost, illegal, begin and audit of
    each chunk. rows: those of the repaired conversations, conv_id, first and
    number (their order), edit, turn, role and text. facts: conv_id, gaps."""

    chunks: DataFrame
    rows: DataFrame
    facts: DataFrame


def repair(rows: DataFrame, costs: Costs = Costs()) -> Repaired:
    """Of rows (conv_id, turn, role, text) the cheapest repair of each conversation.

    Rows are taken by turn, nulls first, then by role and SHA-256 of the text.
    Null role or text counts as one space; a null conv_id is a conversation of
    its own. Rows that repeat are duplicates but for the first; empty text is
    blank; texts of any length are read whole. No other columns are read. No
    rows: no conversations."""
    filled = F.coalesce
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(filled(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    placed = numbered(rows)
    found = stage(edits(chunks(placed), costs), "conversation_edits")

    audits = found.select("conv_id", "first", "begin", "audit", "roles", "counts")
    stay = _mapped(audits, _staying, "number bigint, edit string, place bigint, role string", "begin", "audit", "roles", "counts")
    new = stay.where("place IS NULL").select("conv_id", "first", "number", "edit", F.lit(None).cast("long").alias("turn"), "role", F.lit("").alias("text"))
    # a text is read where its row stays; equal rows are one before the shuffle
    texts = rows.select(_at(), "text").groupBy("at").agg(F.any_value("text").alias("text"))
    old = stay.where("place IS NOT NULL").withColumnRenamed("role", "given").join(placed.select("place", "at"), "place").join(texts, "at")
    old = old.select("conv_id", "first", "number", "edit", F.col("at.turn").alias("turn"), F.coalesce("given", "at.role").alias("role"), "text")
    turn = F.col("at.turn")
    gaps = F.coalesce(F.max(turn) - F.min(turn) + 1 - F.countDistinct(turn), F.lit(0))
    return Repaired(found, old.unionByName(new), placed.groupBy(F.col("at.conv_id").alias("conv_id")).agg(gaps.alias("gaps")))


def digests(rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` lines. A hash of a conversation reads
    it from first to last, so a conversation passes through one task, row by row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        names = ["conv_id", "repaired_sha256"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names)

        for batch in batches:
            for found, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sha is None or found != conv:
                    if sha is not None:
                        yield row()
                    conv, sha = found, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "replace"))
        if sha is not None:
            yield row()

    ordered = _chained(rows.select("conv_id", "first", "number", "role", "text"), F.col("first"), F.col("number"))
    return ordered.select("conv_id", "role", "text").mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults by a checksum of conv_id and
    turn: dropped, emptied, without full stops, repeated, or said by the user."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.coalesce(F.col("text"), blank))
    out = rows.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), blank)).alias("role"), text.alias("text"), kind.alias("kind")
    )
    return out.where("kind <> 0").withColumn("kind", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation of the table, also where damage leaves no row
    of it (see repair for nulls, repeats, ties and texts)."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = repair(damaged(rows))
    c = F.col
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "audit"))), lambda x: x["audit"]), "")
    sums = done.chunks.groupBy("conv_id").agg(
        *(F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")), F.min_by("cost", "first").alias("cost"), audit.alias("audit")
    )
    parts = [rows.select(c("conv_id").cast("long").alias("conv_id")).distinct(), done.facts, sums, digests(done.rows)]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return whole.groupBy("conv_id").agg(
        *(F.coalesce(F.max(x), F.lit(0)).cast("long").alias(x) for x in counts), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
