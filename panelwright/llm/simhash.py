"""SimHash near-duplicates over a byte-position inverted index.

Fingerprints of eight bytes that differ in at most d bits share at least 8 - d
positional bytes. The posting list of one byte at one position holds about
1/256 of all fingerprints, so lists are intersected before they are read: keys
are the bytes at 7 - d positions, and the choices of positions are such that
every pair with the guaranteed minimum of shared bytes meets at one of them.
Pairs that meet share one byte less than that minimum; their shared positional
bytes are tallied, those below the minimum go, and the bits of the others are
compared.

Equal fingerprints are merged first, however many documents carry them. A list
that is still long (a cluster of fingerprints close to each other) is intersected
with nibbles of the remaining bytes, which leaves at most 256 fingerprints in a
list for d = 2, and again loses no pair.

The pipeline's stage asks for more than two bits of 64 can tell: five-word
shingles with a Jaccard similarity of 0.8 differ in 15 % of a fingerprint's bits,
for which no shared byte is guaranteed. So its SimHash has 3,072 bits, of which
such texts share a quarter of the bytes. Lists are keyed by two positional bytes
each; pairs that meet go on if 128 of their bits are near, their shared
positional bytes are tallied over the whole fingerprint, then its bits compared,
and the pairs that remain are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, stage, table, texts
from .components import connected_components

#: Fingerprints beyond which a list is intersected with nibbles.
LONG_LIST = 4096
#: 256 x 8: the bits of a byte, lowest first.
_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's shingles; a text without words has 0."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return 0
    line = b" ".join(found)
    if n <= words:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (of(line[a:z], seed) for a, z in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1
    )
    by_byte = hashes.view(np.uint8).reshape(-1, 8)
    value = 0
    for k in range(8):
        ones = np.bincount(by_byte[:, k], minlength=256) @ _BITS
        for j in np.flatnonzero(2 * ones > len(hashes)).tolist():
            value |= 1 << (8 * k + j)
    return value


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long of every row of docs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in texts(batches):
            fps = np.array([fingerprint(x, words) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(of, "id long, fp long")


def _shared_bytes(x: Column) -> Column:
    """How many of the eight bytes of x are zero."""
    return sum((F.when(F.shiftrightunsigned(x, 8 * k).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0) for k in range(8)), F.lit(0))


def position_choices(max_bits: int) -> list[tuple[int, ...]]:
    """Choices of 7 - max_bits of the eight positions, so that each max_bits
    positions are avoided by one of them. Chosen greedily: 11 for two bits."""
    gaps = set(combinations(range(8), max_bits))
    chosen = []
    while gaps:
        left_out = max(combinations(range(8), max_bits + 1), key=lambda c: sum(g in gaps for g in combinations(c, max_bits)))
        gaps -= set(combinations(left_out, max_bits))
        chosen.append(tuple(k for k in range(8) if k not in left_out))
    return chosen


def _mask(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _posted(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, at, bytes): the bytes of every mask."""
    entries = F.array(*(F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(_mask(m))).alias("bytes")) for i, m in enumerate(masks)))
    return fps.select("fp", F.explode(entries).alias("p")).select("fp", F.col("p.at").alias("at"), F.col("p.bytes").alias("bytes"))


def _met(posted: DataFrame, keep: int, max_bits: int) -> DataFrame:
    """(a, b) of the pairs in a list that pass the count filter and are near."""
    l, r = posted.alias("l"), posted.alias("r")
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    same = (F.col("l.at") == F.col("r.at")) & (F.col("l.bytes") == F.col("r.bytes")) & (F.col("l.fp") < F.col("r.fp"))
    counted = l.join(r, same).where(_shared_bytes(x) >= keep)
    return counted.where(F.bit_count(x) <= max_bits).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def links(fps: DataFrame, max_bits: int = 2, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): all pairs a < b of different fingerprints `fp` (distinct rows)
    that differ in at most max_bits bits, 1 to 4. Lists of more than `long_list`
    fingerprints are intersected further: of the 2 (max_bits + 1) nibbles of the
    other bytes, a pair shares all but max_bits, so it meets in one of the lists
    keyed by that many nibbles."""
    keep, choices = 8 - max_bits, position_choices(max_bits)
    masks = [sum(255 << (8 * k) for k in at) for at in choices]
    posted = _posted(fps, masks)
    long = stage(posted.groupBy("at", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > long_list).select("at", "bytes"), "long_lists")
    short = posted.join(long, ["at", "bytes"], "left_anti")
    nibbles = [[4 * j for j in range(16) if j // 2 not in at] for at in choices]
    finer = [[m | sum(15 << j for j in js) for js in combinations(n, len(n) - max_bits)] for m, n in zip(masks, nibbles, strict=True)]
    by_choice = F.array(*(F.array(*(F.lit(_mask(m)) for m in ms)) for ms in finer))
    split = posted.join(long, ["at", "bytes"], "left_semi").select("fp", "at", F.posexplode(F.get(by_choice, F.col("at"))).alias("k", "m"))
    split = split.select("fp", (F.col("at") * len(finer[0]) + F.col("k")).alias("at"), F.col("fp").bitwiseAND(F.col("m")).alias("bytes"))
    return _met(short, keep, max_bits).union(_met(split, keep, max_bits)).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component) for every row of docs: component is the least id
    that can be reached over links of at most max_bits differing bits.

    Null or wordless text has fingerprint 0 and links like any other; a null id
    keeps its row but can't name a component (a component of null ids only is
    null). Rows that share an id are kept; no rows: no rows.
    """
    prints = stage(with_fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), max_bits))
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = stage(classes, "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    by_print = named.join(least, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@dataclass(frozen=True)
class Copies:
    """Of the pipeline's stage: texts whose sets of `words`-word shingles have a
    Jaccard similarity of at least `similarity` are near-duplicates.

    A fingerprint has `longs` longs, twice as many for texts of up to `few`
    shingles, whose sums are often level. Each two bytes of it are a list's key.
    At a similarity of 0.8 a bit differs with a chance of 0.15 (five shingles and
    four of them: 0.19), and all but about one pair in a million meet in a list.
    Of pairs that meet, those go on that differ in at most `near` of the first
    128 bits (loses less than one in a million; texts of few shingles meet in
    lists of their own too, with `near_few`), share `shared` positional bytes and
    differ in at most `bits` bits of `longs` longs (less than one in a million
    each). Of the first `lead` longs' lists one member is compared with the others
    beforehand. A list is long that has more than `long_list` members besides four
    times those that chance deals; `pivots` members of a list of shared shingles
    are compared with the others before all pairs are."""

    words: int = 5
    similarity: float = 0.8
    longs: int = 48
    lead: int = 6
    few: int = 5
    near: int = 42
    near_few: int = 50
    shared: int = 36
    bits: int = 700
    long_list: int = 16
    pivots: int = 16


def shingle_set(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer
    words has one, a text without words none."""
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    line = b" ".join(found)
    n = len(found)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    of = xxhash.xxh64_intdigest
    pairs = zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((of(line[a:z], 42) for a, z in pairs), np.uint64, n - words + 1))


def _ones(rows: np.ndarray) -> np.ndarray:
    """How many of the rows (n x longs) have each bit, lowest first: the rows are
    added two and two, as numbers whose digits lie in one plane each."""
    planes = [rows]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.concatenate([p, np.zeros_like(p[:1])]) for p in planes]
        half = len(planes[0]) // 2
        carry, added = None, []
        for p in planes:
            l, r = p[:half], p[half:]
            one, both = l ^ r, l & r
            if carry is not None:
                one, both = one ^ carry, both | (one & carry)
            added.append(one)
            carry = both
        planes = [*added, carry]
    return sum(np.unpackbits(p[0].view(np.uint8), bitorder="little").astype(np.int64) << k for k, p in enumerate(planes))


@lru_cache(4)
def _odd(longs: int) -> np.ndarray:
    return np.random.default_rng(42).integers(0, 1 << 63, (longs, 2), np.uint64).T.copy() | np.uint64(1)


def wide_fingerprint(grams: np.ndarray, longs: int) -> np.ndarray:
    """SimHash of 64 * longs bits: a bit is 1 if over half of the shingles' hashes
    have it. Fewer longs are the beginning of more."""
    odd = _odd(longs)
    ones = np.zeros(64 * longs, np.int64)
    for i in range(0, len(grams), 4096):
        x = (grams[i : i + 4096, None] ^ odd[1]) * odd[0]
        x = (x ^ (x >> np.uint64(32))) * odd[1]
        ones += _ones(x ^ (x >> np.uint64(29)))
    return np.packbits(2 * ones > len(grams), bitorder="little").view(np.int64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _sketches(docs: DataFrame, copies: Copies) -> DataFrame:
    """(id, node, places, text): node is a hash of the set of shingles, places
    the fingerprint as longs (none for a text of so few shingles that no other
    set is similar enough)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in texts(batches):
            nodes, places = [], []
            for text in found:
                grams = shingle_set(text, copies.words)
                nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), 42) if len(grams) else 0)
                n = len(grams)
                longs = 0 if n < copies.similarity * (n + 1) else copies.longs * (2 if n <= copies.few else 1)
                places.append(wide_fingerprint(grams, longs))
            offsets = np.cumsum([0, *map(len, places)])
            longs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(places)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.array(nodes, np.uint64).view(np.int64)), longs, pa.array(found, pa.binary())],
                ["id", "node", "places", "text"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, "id long, node long, places array<long>, text binary")


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of longs; of signed ones numpy would count the absolute value's."""
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64)


def _posted_bytes(nodes: DataFrame, longs: int, by: list[str]) -> DataFrame:
    """(key, node, root, x, y) of nodes (node, root, places), dealt by the key and
    sorted: a key for each two positional bytes of the first `longs` longs; x and
    y are the first 128 bits."""
    words = nodes.select("node", "root", F.get("places", F.lit(0)).alias("x"), F.get("places", F.lit(1)).alias("y"), F.posexplode(F.slice("places", 1, longs)).alias("i", "w"))
    keys = F.array(*(F.shiftleft(F.col("i") * 4 + j, 16) + F.shiftrightunsigned("w", 16 * j).bitwiseAND(F.lit(65535)).cast("int") for j in range(4)))
    posted = words.select(F.explode(keys).alias("key"), "node", "root", "x", "y")
    return posted.repartition(partitions(nodes.sparkSession), "key").sortWithinPartitions("key", *by)


def _numpy(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _with_first(nodes: DataFrame, copies: Copies) -> DataFrame:
    """(a, b): of each list of the first `lead` longs its first member with every
    other one that is near in the first 128 bits: a large group of copies makes a
    pair for each member and list."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first member of the last list, which may go on
        for batch in batches:
            columns = _numpy(batch)
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            key, node, _, x, y = columns
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            to = np.repeat(starts, np.diff(np.append(starts, len(key))))
            met = np.flatnonzero((_apart(x, x[to]) + _apart(y, y[to]) <= copies.near) & (node != node[to]))
            yield pa.RecordBatch.from_arrays([pa.array(node[to[met]], pa.int64()), pa.array(node[met], pa.int64())], ["a", "b"])
            held = [c[starts[-1] : starts[-1] + 1] for c in columns]

    return _posted_bytes(nodes, copies.lead, ["node"]).mapInArrow(of, "a long, b long").distinct()


def _met_apart(nodes: DataFrame, copies: Copies, n: int) -> DataFrame:
    """(a, b, long) of nodes (node, root, places), n at most: of each list the
    pairs of nodes of different roots that are near in the first 128 bits. Of a
    long list, and of the near members of one that would make as many pairs as
    they are, the roots instead if there are several (long is true, a is b)."""
    most = copies.long_list + n // 16384
    few = 4 * copies.longs << 16  # the first key of the lists of texts of few shingles

    def rows(a: np.ndarray, b: np.ndarray, long: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), long))], ["a", "b", "long"])

    def open_roots(key: np.ndarray, root: np.ndarray, told: list[np.ndarray]) -> pa.RecordBatch:
        at = np.flatnonzero((key[1:] == key[:-1]) & (root[1:] != root[:-1]))
        found = np.setdiff1d(np.concatenate([root[at], root[at + 1]]), told[0])
        told[0] = np.concatenate([told[0], found]) if len(told[0]) < 1 << 16 else found
        return rows(found, found, True)

    def compared(key: np.ndarray, node: np.ndarray, root: np.ndarray, x: np.ndarray, y: np.ndarray, ends: np.ndarray, at: np.ndarray, told: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        step, left, right = 1, [at[:0]], [at[:0]]
        while len(at := at[at + step < ends[at]]):
            apart = _apart(x[at], x[at + step]) + _apart(y[at], y[at + step])
            met = at[(apart <= np.where(key[at] < few, copies.near, copies.near_few)) & (root[at] != root[at + step])]
            left.append(met)
            right.append(met + step)
            step += 1
        l, r = np.concatenate(left), np.concatenate(right)
        if not len(l):
            return
        near = np.unique(np.concatenate([l, r]))  # members of a list with another one near
        lists, back, members = np.unique(key[near], return_inverse=True, return_counts=True)
        of = np.searchsorted(lists, key[l])
        dense = np.bincount(of, minlength=len(lists)) >= members
        one = ~dense[of]
        yield rows(np.minimum(node[l[one]], node[r[one]]), np.maximum(node[l[one]], node[r[one]]), False)
        many = near[dense[back]]
        yield open_roots(key[many], root[many], told)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        told = [np.empty(0, np.int64)]  # roots that this task has given lately
        goes_on = False  # whether the first row is the last one of a long list's beginning
        for batch in _and_none(batches):
            if batch is not None:
                columns = _numpy(batch)
                held = columns if held is None else [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
            if held is None or not len(held[0]):
                continue
            key = held[0]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            long = sizes > most
            long[0] |= goes_on
            of_long = np.repeat(long, sizes)
            yield open_roots(key[of_long], held[2][of_long], told)
            whole = len(key) if batch is None else int(starts[-1])  # the last list may go on
            ends = np.repeat(starts + sizes, sizes)
            yield from compared(*held, ends, np.flatnonzero(~of_long[:whole]), told)
            goes_on = bool(long[-1]) and batch is not None
            held = [h[len(key) - 1 if goes_on else whole :] for h in held]

    return _posted_bytes(nodes, 2 * copies.longs, ["root", "node"]).mapInArrow(of, "a long, b long, long boolean")


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _tallied(pairs: DataFrame, nodes: DataFrame, copies: Copies) -> DataFrame:
    """The pairs (a, b) of nodes that share enough positional bytes and are near."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.flatten().to_numpy().reshape(-1, copies.longs) for c in batch.columns[2:])
            shared = (x.view(np.uint8) == y.view(np.uint8)).sum(axis=1)
            kept = np.flatnonzero(shared >= copies.shared)
            kept = kept[_apart(x[kept], y[kept]).sum(axis=1) <= copies.bits]
            yield batch.select(["a", "b"]).take(pa.array(kept))

    places = F.slice("places", 1, copies.longs)
    x, y = nodes.select(F.col("node").alias("a"), places.alias("x")), nodes.select(F.col("node").alias("b"), places.alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def _verified(pairs: DataFrame, held: DataFrame, copies: Copies) -> DataFrame:
    """The pairs (a, b) of nodes whose shingles are similar enough."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = lru_cache(64)(lambda text: shingle_set(text, copies.words))
        for batch in batches:
            rows = zip(batch.column(2), batch.column(3), strict=True)
            near = [jaccard(grams(x.as_py()), grams(y.as_py())) >= copies.similarity for x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left, right = held.select(F.col("node").alias("a"), F.col("text").alias("x")), held.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def _prefixes(wanted: DataFrame, held: DataFrame, copies: Copies) -> DataFrame:
    """(node, size, share, place, gram): with the shingles of each node ordered
    from the rarest on, the first (1 - t) n + 1 of n for the similarity t, with
    their places; share is the part of its shingles that others have. Two nodes as similar as that share one of them. wanted: (node,
    root); shingles that only nodes of one root have are left out (but counted),
    since pairs of one root aren't asked for."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = shingle_set(text, copies.words).view(np.int64)
                n = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, v)) for v in (node, root, n)] + [pa.array(grams)], ["node", "root", "size", "gram"])

    grams = wanted.join(held, "node").select("node", "root", "text").mapInArrow(of, "node long, root long, size long, gram long")
    common = grams.groupBy("gram").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("gram", "n")
    # those left out come first in the order
    listed = grams.join(common, "gram").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("found"))
    first = F.floor((1 - F.lit(copies.similarity)) * F.col("size") + 1e-9) + 1
    place = F.col("size") - F.size("found") + F.col("k") + 1
    listed = listed.select("node", "size", "found", F.posexplode("found").alias("k", "f"))
    return listed.where(place <= first).select("node", "size", (F.size("found") / F.col("size")).alias("share"), place.alias("place"), F.col("f.gram").alias("gram"))


def _paired(l: DataFrame, r: DataFrame, once: Column, copies: Copies) -> DataFrame:
    """(a, b): nodes of different roots that share a shingle at places that leave
    enough of both behind it; `once` tells which of (l, r) and (r, l) to make."""
    t = copies.similarity
    need = F.ceil(F.lit(t / (1 + t)) * (F.col("l.size") + F.col("r.size")) - 1e-9)
    rest = F.least(F.col("l.size") - F.col("l.place"), F.col("r.size") - F.col("r.place")) + 1
    met = l.alias("l").join(r.alias("r"), (F.col("l.gram") == F.col("r.gram")) & (F.col("l.root") != F.col("r.root")) & once & (rest >= need))
    return met.select(F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")).distinct()


def _with_some(posted: DataFrame, copies: Copies) -> DataFrame:
    """Pairs of each node with a few nodes of its lists: of each of `pivots` parts
    of a list (by a hash) the one with the largest share of shared shingles."""
    part = F.pmod(F.xxhash64("node"), F.lit(copies.pivots))
    best = F.max_by(F.struct("node", "root", "size", "place"), F.struct("share", "node"))
    pivots = posted.groupBy("gram", part.alias("part")).agg(best.alias("p")).select("gram", "p.*")
    return _paired(posted, pivots, F.lit(True), copies)


def _with_all(posted: DataFrame, copies: Copies) -> DataFrame:
    """All pairs of different roots. The root with most nodes of a list isn't
    paired with itself, however many they are."""
    per_root = posted.groupBy("gram", "root").agg(F.count("*").alias("n"))
    main = per_root.groupBy("gram").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("gram", "main")
    dealt = stage(posted.join(main, "gram"), "prefixes")
    once = (F.col("r.root") == F.col("r.main")) | (F.col("l.node") < F.col("r.node"))
    return _paired(dealt.where("root != main"), dealt, once, copies)


def near_copies(docs: DataFrame, copies: Copies = Copies()) -> DataFrame:
    """(id, component) for every row of docs: component is the least id that can
    be reached over texts of enough similarity. Texts without words are alike.

    Some lists' members are compared with one of them first, so that a large
    group of copies costs a comparison each. Of all lists then all pairs are tried
    whose nodes are still apart. A long list, or one of many near members, makes
    no pairs: if they are of more than one component, all nodes of these are
    compared through the prefix filter, which is exact and makes pairs only of
    those that share rare shingles: texts that share a frequent passage, but not
    enough, aren't paired with each other. Of these too a few in each list come
    first, and then all pairs of components that are still apart.

    Null text counts as empty. Null ids take part, but can't name a component (a
    component of null ids only is null). Rows that share an id but not a text
    link their groups in no way; repeated rows are copies. No rows: no rows.
    """
    sketched = stage(_sketches(docs, copies), "sketches")
    nodes = stage(sketched.groupBy("node").agg(F.min("id").alias("least"), F.first("places").alias("places")), "nodes")
    longs = nodes.where(F.size("places") > 0)

    def texts_of(asked: DataFrame) -> DataFrame:
        # one row of each text, found by its node and id: a large group of copies isn't gathered
        chosen = nodes.join(asked.distinct(), "node", "left_semi").select(F.col("node").alias("of"), "least")
        rows = sketched.join(chosen, (F.col("node") == F.col("of")) & F.col("id").eqNullSafe(F.col("least")))
        return stage(rows.groupBy("node").agg(F.first("text").alias("text")), "candidates")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    first = stage(_tallied(_with_first(longs.withColumn("root", F.col("node")), copies), nodes, copies), "tallied")
    links = stage(_verified(first, texts_of(ends(first)), copies), "near")
    roots = stage(connected_components(links), "roots")
    rooted = stage(longs.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    met = stage(_met_apart(rooted, copies, nodes.count()), "met")
    second = stage(_tallied(met.where("NOT long").select("a", "b").distinct(), nodes, copies), "tallied")
    open_roots = met.where("long").select(F.col("a").alias("root")).distinct()
    wanted = stage(rooted.join(open_roots, "root", "left_semi").select("node", "root"), "wanted")
    held = texts_of(ends(second).union(wanted.select("node")))
    links = stage(links.union(_verified(second, held, copies)), "near")
    roots = connected_components(links)
    prefixes = stage(_prefixes(wanted, held, copies), "prefixes")
    for paired in (_with_some, _with_all):
        rooted = prefixes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        found = _verified(_tallied(paired(rooted, copies), nodes, copies), held, copies)
        links = stage(links.union(stage(found, "near")), "near")
        roots = connected_components(links)
    named = stage(nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "classes")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    return sketched.select("id", "node").join(named.join(least, "root").select("node", "component"), "node").select("id", "component")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates (near_copies) the
    document with the least id stays. Rows of one id are one document, which
    stays or goes as a whole: it goes if any of them has a copy of a smaller id.
    Documents without an id can't be told apart and stay."""
    found = near_copies(docs)
    gone = found.where("id != component").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
