"""Exact removal of repeated byte strings by suffix arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts
elsewhere, in the same or another document. Equal strings have the same least
k-gram (by hash) at the same place, so texts are cut into runs of windows with
one least k-gram, and windows can only equal windows of runs with that k-gram.
Runs whose k-gram occurs once hold nothing repeated. Of the others

* runs equal as a whole are aggregated (before the shuffle), and are repeated;
* different runs of one k-gram are put into one text each, whose suffix array
  (by linear grouping, see lyndon.py) brings equal windows side by side, where
  they are compared byte by byte;
* a k-gram with very many different runs (a frequent phrase in ever new
  surroundings) isn't gathered: its runs' windows are keyed by a 128-bit hash
  each and counted, which a cluster spreads evenly.

Texts lie in a bucketed table of blocks and aren't shuffled: what is sent is a
row for each run (one for about 77 bytes), and the bytes of each different run
once. No copies are dropped in any way, whatever their number. Bytes are compared
in suffix arrays; runs equal as a whole are told by a 64-bit hash of their bytes
within one k-gram's, spread windows by two 64-bit hashes, which could in principle
meet by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, stage, table
from .blocks import BLOCK_BYTES, dropped, ids_of, packed, unpack
from .lyndon import suffix_arrays

LENGTH = 200
GRAM = 48
#: Different runs of a k-gram beyond which its windows are spread by hash.
MANY = 32
#: Bytes that one batch of suffix arrays takes.
BATCH = 2 << 20
#: Window starts handled at once; places within fit the low bits of a key.
_SLICE, _BITS = 1 << 21, 22

_BASE = 0x9E3779B97F4A7C15


def _grams(data: np.ndarray, k: int, base: int = _BASE) -> np.ndarray:
    """A 64-bit hash of the k bytes from each position (len - k + 1 values)."""
    power, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if k & width:
            if out is None:
                out = power
            else:
                m = min(len(out), len(power) - done)
                out = out[:m] * np.uint64(pow(base, width, 1 << 64)) + power[done : done + m]
            done += width
        if done == k:
            break
        power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:]
        width *= 2
    out = out[: len(data) - k + 1]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, windows, k-gram) of each run in the texts of these sizes, one after
    the other in data: windows of `length` bytes start at begin, begin + 1, ..."""
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    room = np.repeat(np.cumsum(sizes), sizes)[: len(data) - length + 1] - np.arange(len(data) - length + 1)
    valid = room >= length
    begins, counts, keys = [], [], []
    for a in range(0, len(valid), _SLICE):
        z = min(a + _SLICE, len(valid))
        hashes = _grams(data[a : z + length - 1], gram)
        low = np.uint64((1 << _BITS) - 1)
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(ranked, length - gram + 1) & low).astype(np.int64)
        ok = valid[a:z]
        edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (ok[1:] != ok[:-1]))))
        count = np.diff(np.append(edge, z - a))
        ok = ok[edge]
        begins.append(edge[ok] + a)
        counts.append(count[ok])
        keys.append(hashes[place[edge[ok]]])
    return np.concatenate(begins), np.concatenate(counts), np.concatenate(keys)


def repeated_windows(groups: list[list[bytes]], length: int = LENGTH) -> list[list[list[tuple[int, int]]]]:
    """Of each text of each group the windows (begin, how many in a row) that
    occur at another place of the group, by the group's suffix array."""
    symbols, sizes, owner = [], [], []
    for group in groups:
        n = 0
        for text in group:
            symbols += [np.frombuffer(text, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
            owner.append(len(text) + 1)
            n += len(text) + 1
        symbols[-1] = np.zeros(1, np.int64)
        sizes.append(n)
    joined = np.concatenate(symbols)
    array = suffix_arrays(joined, np.array(sizes))
    owned = np.array(owner)
    room = np.repeat(np.cumsum(owned) - 1, owned) - np.arange(len(joined))
    array = array[room[array] >= length]
    text_group = np.repeat(np.arange(len(sizes)), sizes)
    mark = np.zeros(len(joined), bool)
    views = np.lib.stride_tricks.sliding_window_view(joined.astype(np.uint16), length)
    for i in range(0, len(array) - 1, 20_000):
        a, b = array[i : i + 20_000], array[i + 1 : i + 20_001]
        a = a[: len(b)]
        near = np.flatnonzero((joined[a] == joined[b]) & (joined[a + length - 1] == joined[b + length - 1]) & (text_group[a] == text_group[b]))
        same = near[(views[a[near]] == views[b[near]]).all(axis=1)]
        mark[a[same]] = mark[b[same]] = True
    out, at = [], 0
    for group in groups:
        found = []
        for text in group:
            edge = np.diff(np.concatenate(([0], mark[at : at + len(text)].view(np.int8), [0])))
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            found.append(list(zip(first.tolist(), (last - first).tolist(), strict=True)))
            at += len(text) + 1
        out.append(found)
    return out


def _held(joined: bytes, sizes: np.ndarray, length: int, gram: int) -> bytes:
    """What is kept with a block, so that its text is cut into runs once: where they
    begin and their windows, then each one's k-gram and the hash of the whole run."""
    begin, count, key = runs(np.frombuffer(joined, np.uint8), sizes, length, gram)
    of = xxhash.xxh64_intdigest
    whole = np.fromiter((of(joined[a:z]) for a, z in zip(begin.tolist(), (begin + count + length - 1).tolist(), strict=True)), np.uint64, len(begin))
    places = zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(begin, prepend=0), count]).astype(np.int32).tobytes())
    return np.int64(len(places)).tobytes() + places + key.astype(np.uint64).tobytes() + whole.tobytes()


def _from_held(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(begin, windows) of each run."""
    size = int(np.frombuffer(data, np.int64, 1)[0])
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]), np.int32).astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def _hashes(data: bytes) -> np.ndarray:
    """The k-grams of the runs, and the hashes of the whole runs: two rows."""
    size = int(np.frombuffer(data, np.int64, 1)[0])
    return np.frombuffer(data[8 + size :], np.int64).reshape(2, -1)


def _batch(columns: list, kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def deduplicate(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, many: int = MANY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of docs
    (doc_id, text). Null text counts as empty; repeated rows are documents of
    their own, and so remove each other; texts shorter than `length` lose nothing.
    Texts are read whole; a longer one than a block is a block of its own. No rows: no rows."""
    name = packed(docs, block_bytes, lambda joined, sizes: _held(joined, sizes, length, gram))
    with dropped(docs.sparkSession, name) as blocks:
        return _deduplicated(blocks, length, gram, many)


def _deduplicated(blocks: DataFrame, length: int, gram: int, many: int) -> DataFrame:
    spark = blocks.sparkSession

    def list_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, whole = _hashes(extra)
                yield _batch(
                    [key, whole, np.full(len(key), block), np.arange(len(key), dtype=np.int32)],
                    [pa.int64(), pa.int64(), pa.int64(), pa.int32()], ["gram", "whole", "block", "run"],
                )

    every = blocks.select("block", "extra").mapInArrow(list_runs, "gram long, whole long, block long, run int")
    # written, so that the join deals both of its sides and can split a frequent k-gram's
    grams = every.groupBy("gram").agg(F.count("*").alias("n"), (F.min("whole") < F.max("whole")).alias("mixed")).where("n > 1").select("gram", "mixed")
    met = stage(every.join(stage(grams, "grams"), "gram"), "runs")
    kinds = stage(met.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.first("mixed").alias("mixed"), F.min(F.struct("block", "run")).alias("at")), "kinds")
    # different runs of one k-gram: their bytes, once each, unless all are known to be repeated
    mixed = kinds.where("mixed")
    fan = stage(mixed.groupBy("gram").agg((F.count("*") > many).alias("spread"), F.min("n").alias("least")).where("least = 1").select("gram", "spread"), "fans")
    wanted = mixed.join(fan, "gram").groupBy("at.block").agg(F.collect_list(F.struct("at.run", "gram", "n", "spread")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, text, extra, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                joined, (begin, count) = b"".join(unpack(sizes, text)), _from_held(extra)
                bodies = [joined[begin[w["run"]] : begin[w["run"]] + count[w["run"]] + length - 1] for w in asked]
                yield _batch(
                    [[w["gram"] for w in asked], [w["n"] for w in asked], [w["spread"] for w in asked], [block] * len(asked), [w["run"] for w in asked], bodies],
                    [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()], ["gram", "n", "spread", "block", "run", "body"],
                )

    bodies = stage(blocks.join(wanted, "block").select("block", "sizes", "text", "extra", "wanted").mapInArrow(fetch, "gram long, n long, spread boolean, block long, run int, body binary"), "bodies")
    found_schema = "block long, run int, begin int, windows int"
    found_kinds, found_names = [pa.int64(), pa.int32(), pa.int32(), pa.int32()], ["block", "run", "begin", "windows"]

    def sort_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple]] = []
        size, last = 0, None

        def search() -> pa.RecordBatch:
            order = sorted(range(len(held)), key=lambda i: sum(len(r[4]) for r in held[i]))
            rows = []
            marks = repeated_windows([[r[4] for r in held[i]] for i in order], length)
            for i, found in zip(order, marks, strict=True):
                for (_, n, block, run, _), spans in zip(held[i], found, strict=True):
                    rows += [(block, run, a, w) for a, w in spans if n == 1]
            return _batch([[r[j] for r in rows] for j in range(4)], found_kinds, found_names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if size >= BATCH:
                        yield search()
                        held, size = [], 0
                    held.append([])
                    last = row[0]
                held[-1].append(row)
                size += len(row[4])
        if held:
            yield search()

    def list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, block, run, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(body, np.uint8)
                w = len(data) - length + 1
                yield _batch(
                    [_signed(_grams(data, length)), _signed(_grams(data, length, 0xD6E8FEB86659FD93)), np.full(w, n), np.full(w, block), np.full(w, run, np.int32), np.arange(w, dtype=np.int32)],
                    [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], ["h1", "h2", "n", "block", "run", "begin"],
                )

    sorted_bodies = bodies.where("NOT spread").select("gram", "n", "block", "run", "body").repartition(partitions(spark), "gram").sortWithinPartitions("gram")
    by_suffixes = sorted_bodies.mapInArrow(sort_suffixes, found_schema)
    windows = bodies.where("spread").select("n", "block", "run", "body").mapInArrow(list_windows, "h1 long, h2 long, n long, block long, run int, begin int")
    again = windows.groupBy("h1", "h2").agg(F.sum("n").alias("total")).where("total > 1").select("h1", "h2")
    by_hash = windows.where("n = 1").join(again, ["h1", "h2"]).select("block", "run", "begin", F.lit(1).alias("windows"))
    whole = met.join(kinds.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select("block", "run", F.lit(0).alias("begin"), F.lit(-1).alias("windows"))
    removed = whole.unionByName(by_suffixes).unionByName(by_hash)
    by_block = removed.groupBy("block").agg(F.collect_list("run").alias("run"), F.collect_list("begin").alias("begin"), F.collect_list("windows").alias("windows"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, sizes, text, extra, run, first, windows in zip(*batch.columns, strict=True):
                ids, known, sizes, text, extra = (x.as_py() for x in (ids, known, sizes, text, extra))
                found = unpack(sizes, text)
                joined, (begin, count) = b"".join(found), _from_held(extra)
                cover = np.zeros(len(joined) + 1, np.int32)
                if run.is_valid:
                    run, first, windows = (x.values.to_numpy(zero_copy_only=False) for x in (run, first, windows))
                    a = begin[run] + first
                    n = np.where(windows < 0, count[run], windows)
                    cover += np.bincount(a, minlength=len(cover)).astype(np.int32)
                    cover -= np.bincount(a + n + length - 1, minlength=len(cover)).astype(np.int32)
                gone = np.cumsum(cover[:-1]) > 0
                data = np.frombuffer(joined, np.uint8)
                rows, at = [], 0
                for body in found:
                    mask = gone[at : at + len(body)]
                    lost = int(mask.sum())
                    spans = int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if lost else 0
                    rest = data[at : at + len(body)][~mask].tobytes() if lost else body
                    rows.append((len(body), lost, spans, hashlib.sha256(rest).hexdigest()))
                    at += len(body)
                columns = [ids_of(ids, known), *([r[i] for r in rows] for i in range(4))]
                yield _batch(columns, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = blocks.join(by_block, "block", "left").select("ids", "known", "sizes", "text", "extra", "run", "begin", "windows")
    return stage(joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "kept")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))
