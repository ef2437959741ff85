"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are cut into overlapping probes. A stretch of a document within
e edits of a probe of m characters shares at least m - q + 1 - q*e of its
q-grams, and these lie on diagonals at most e apart. So shared q-grams are
counted in bands of diagonals that overlap, only bands with that many counts are
retained, and an alignment within the band verifies each. Neighbouring probes
overlap; their q-grams are counted together first, and probe by probe only on
diagonals where that count is high enough.

The probes' q-grams are held in shards of bounded size (SHARD_CHARS characters
of benchmark text): a larger benchmark takes more shards and as many passes over
the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, texts

SHARD_CHARS = 4_000_000
#: Diagonals whose bands are counted at once, however long a document is.
_PIECE = 1 << 17
#: Meetings of a text's q-grams with the probes' that are counted at once.
_MEETINGS = 250_000
#: Probes at most whose q-grams are first counted together.
_STRETCH = 32
#: Buckets at most (as a power of 2) of that first count.
_BUCKETS = 18
#: Probes aligned at once.
_ALIGNED = 4096
#: Rows of a batch that the stage judges and hands on at once.
_ROWS = 1024


@dataclass(frozen=True)
class Settings:
    """Bytes after normalisation throughout. A probe of `probe` bytes may differ
    by `edits`; shorter items are one probe with edits in proportion."""

    q: int = 10
    probe: int = 96
    stride: int = 48
    edits: int = 5

    def budget(self, length: int) -> int:
        """In proportion, and few enough that a match must share a q-gram."""
        return max(0, min(self.edits, length * self.edits // self.probe, length // self.q - 1))

    def least(self, length: int) -> int:
        """Shared q-grams that a match guarantees."""
        return length - self.q + 1 - self.q * self.budget(length)


#: Of the query and the stage: a verbatim excerpt of 55 bytes holds a whole probe
#: wherever it begins, and one word in ten may be another.
CORPUS = Settings(q=8, probe=48, stride=8, edits=4)


def normalised(text: bytes) -> bytes:
    """ASCII lower case, white-space runs as one space."""
    return b" ".join(text.lower().split())


def _grams(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q bytes at each position (len - q + 1 values)."""
    base = np.uint64(0x9E3779B97F4A7C15)
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, width = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    while True:
        if q >> (width.bit_length() - 1) & 1:
            if out is None:
                out = power[: len(data)]
            else:
                shifted = power[done:]
                m = min(len(out), len(shifted))
                out = out[:m] * np.uint64(pow(int(base), width, 1 << 64)) + shifted[:m]
            done += width
        if done == q:
            break
        power = power[:-width] * np.uint64(pow(int(base), width, 1 << 64)) + power[width:]
        width *= 2
    out = out[:n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _pieces(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges whose sizes sum to about _MEETINGS."""
    if not len(sizes):
        return []
    total = np.cumsum(sizes)
    cuts = np.unique([0, *np.searchsorted(total, np.arange(_MEETINGS, int(total[-1]), _MEETINGS)).tolist(), len(sizes)]).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


@dataclass(frozen=True)
class Probes:
    """A shard: probe k is data[start[k]:start[k] + length[k]] of item[k].
    Probes that follow each other in an item form stretches: row i is a q-gram
    at data[place[i]] of stretch[i], held by the probes from owner[i], many[i]
    of them; base[j] is where stretch j begins."""

    settings: Settings
    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    item: np.ndarray
    base: np.ndarray
    grams: np.ndarray  # sorted
    place: np.ndarray
    stretch: np.ndarray
    owner: np.ndarray
    many: np.ndarray

    @staticmethod
    def of(items: list[tuple[int, bytes]], settings: Settings) -> Probes:
        start, length, item, at, parts, runs = [], [], [], 0, [], []
        for key, text in items:
            text = normalised(text)
            n = len(text)
            begins = list(range(0, max(1, n - settings.probe + 1), settings.stride))
            if n > settings.probe and begins[-1] + settings.probe < n:
                begins.append(n - settings.probe)
            begins = begins if n else []
            runs += [(len(start) + i, len(start) + min(i + _STRETCH, len(begins))) for i in range(0, len(begins), _STRETCH)]
            for b in begins:
                start.append(at + b)
                length.append(min(settings.probe, n))
                item.append(key)
            parts.append(text)
            at += n
        data = np.frombuffer(b"".join(parts), np.uint8)
        first = np.array(start, np.int64)
        rows: list[tuple[np.ndarray, ...]] = []
        for j, (a, z) in enumerate(runs):  # the probes of stretch j, all as long
            g = _grams(data[start[a] : start[z - 1] + length[a]], settings.q)
            place = start[a] + np.arange(len(g), dtype=np.int64)
            owner = a + np.searchsorted(first[a:z], place - (length[a] - settings.q))
            many = a + np.searchsorted(first[a:z], place, side="right") - owner
            rows.append((g, place, np.full(len(g), j, np.int64), owner, many))
        joined = [np.concatenate(x) for x in zip(*rows, strict=True)] if rows else [np.empty(0, t) for t in (np.uint64, *[np.int64] * 4)]
        order = np.argsort(joined[0], kind="stable")
        order = order[joined[4][order] > 0]
        base = np.array([start[a] for a, _ in runs], np.int64)
        return Probes(settings, data, first, np.array(length, np.int64), np.array(item, np.int64), base, *(x[order] for x in joined))


class Matcher:
    def __init__(self, probes: Probes) -> None:
        self.p = probes
        self.first, where, counts = np.unique(probes.grams, return_index=True, return_counts=True)
        self.where, self.counts = where, counts
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.first >> np.uint64(42)).astype(np.int64)] = True
        s = probes.settings
        self.least = np.array([max(1, s.least(int(n))) for n in probes.length], np.int64)
        self.budget = np.array([s.budget(int(n)) for n in probes.length], np.int64)
        self.short = [k for k in range(len(probes.length)) if probes.length[k] < s.q]
        #: Of all probes with a q-gram: what any band must have.
        self.fewest = int(self.least[probes.length >= s.q].min(initial=1 << 30))
        self.name = np.unique(probes.item, return_inverse=True)[1]

    def match(self, found: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(document's place in found, item, begin, end, edits) for the best
        stretch of each item in each document, in normalised bytes."""
        docs = [normalised(x) for x in found]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, k, begin, end, edits in self._candidates(docs):
            key = (d, int(self.p.item[k]))
            if key not in best or (edits, begin) < (best[key][2], best[key][0]):
                best[key] = (begin, end, edits)
        for k in self.short:  # too short for a q-gram: whole words
            a, n = int(self.p.start[k]), int(self.p.length[k])
            text = b" " + self.p.data[a : a + n].tobytes() + b" "
            for d, doc in enumerate(docs):
                at = (b" " + doc + b" ").find(text)
                if at >= 0:
                    best.setdefault((d, int(self.p.item[k])), (at, at + n, 0))
        return [(d, item, *x) for (d, item), x in sorted(best.items())]

    def _candidates(self, docs: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        p = self.p
        if not len(self.first):
            return
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        gap = p.settings.probe + 2 * p.settings.edits + 2
        begins = np.cumsum(sizes + gap) - sizes  # a gap before each: no diagonal meets two documents
        data = np.zeros(int((begins[-1] + sizes[-1] + gap) if len(docs) else 0), np.uint8)
        for b, doc in zip(begins.tolist(), docs, strict=True):
            data[b : b + len(doc)] = np.frombuffer(doc, np.uint8)
        width = 1 << int(np.ceil(np.log2(2 * (p.settings.edits + 1))))  # bands overlap by half: any edits + 1 diagonals lie in one
        half = width // 2
        wide = max(1, _PIECE // half)
        found = [self._bands(data, b, b + wide, half, gap) for b in range(0, (len(data) + gap) // half + 1, wide)]
        owner, band = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((band, owner))
        owner, band = owner[order], band[order]
        yield from self._verify(data, begins, owner, band * half - gap, width)  # the band's first diagonal, of `width`

    def _bands(self, data: np.ndarray, low: int, high: int, half: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, band) where enough q-grams meet, of the bands from low to high:
        a band is `half` diagonals and the next `half`, and all its q-grams lie
        at most a probe's length behind them."""
        p, q = self.p, self.p.settings.q
        begin = max(0, low * half - gap)
        grams = _grams(data[begin : (high + 1) * half - gap + p.settings.probe + q - 1], q)
        at = np.flatnonzero(self.sieve[(grams >> np.uint64(42)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.first, grams[at]), len(self.first) - 1)
        same = self.first[slot] == grams[at]
        at, slot = at[same] + begin, slot[same]
        keys: list[np.ndarray] = []
        tally: list[np.ndarray] = []
        for a, row in self._dense(at, slot, half):
            for x, y in _pieces(p.many[row]):
                n = p.many[row[x:y]]
                owner = np.repeat(p.owner[row[x:y]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                first = np.repeat(a[x:y] - p.place[row[x:y]], n) + p.start[owner]  # where the probe's first byte would lie
                k, c = np.unique(owner << 40 | (first + gap) // half, return_counts=True)
                keys.append(k)
                tally.append(c)
        if not keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        halves, n = keys[0], tally[0]
        if len(keys) > 1:
            halves, back = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(back, np.concatenate(tally)).astype(np.int64)
        # a band is two halves, and one of them has half of the q-grams at least
        some = halves[2 * n >= self.least[halves >> 40]]
        key = np.unique(np.concatenate([some, some - 1]))
        key = key[(key & ((1 << 40) - 1) >= low) & (key & ((1 << 40) - 1) < high)]
        count = np.zeros(len(key), np.int64)
        for part in (key, key + 1):
            at = np.minimum(np.searchsorted(halves, part), len(halves) - 1)
            count += np.where(halves[at] == part, n[at], 0)
        key = key[count >= self.least[key >> 40]]
        return key >> 40, key & ((1 << 40) - 1)

    def _dense(self, at: np.ndarray, slot: np.ndarray, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, row) of the meetings that may lie in a band with enough of
        them. A band of any of a stretch's probes lies within three halves of the
        stretch's own diagonals. These are counted in buckets, which others may
        share: a count is never too low, so no band is lost or counted short."""
        p = self.p
        buckets = 1 << min(_BUCKETS, max(12, int(2 * self.counts[slot].sum()).bit_length()))

        def meet(x: int, y: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = self.counts[slot[x:y]]
            row = np.repeat(self.where[slot[x:y]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            a, j = np.repeat(at[x:y], n), p.stretch[row]
            return a, row, ((a - p.place[row] + p.base[j]) // half + j * 0x9E3779B1) & (buckets - 1)

        pieces = _pieces(self.counts[slot])
        met = [meet(*piece) for piece in pieces[:1]]
        count = np.zeros(buckets, np.int64)
        for i, piece in enumerate(pieces):
            count += np.bincount((met[0] if not i else meet(*piece))[2], minlength=buckets)
        three = count + np.roll(count, 1) + np.roll(count, -1)
        enough = np.maximum(np.maximum(np.roll(three, 1), np.roll(three, -1)), three) >= self.fewest
        for i, piece in enumerate(pieces):
            a, row, bucket = met.pop() if not i else meet(*piece)
            keep = np.flatnonzero(enough[bucket])
            if len(keep):
                yield a[keep], row[keep]

    def _verify(self, data: np.ndarray, begins: np.ndarray, owner: np.ndarray, low: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int, int]]:
        """The stretches within the budget; of those of one item in one document
        the ones with the fewest edits. Only these are traced to their begin."""
        low = low - self.p.settings.edits
        edits, end, _ = self._align(data, owner, low, width, False)
        document = np.searchsorted(begins, end - 1, side="right") - 1
        good = np.flatnonzero((edits <= self.budget[owner]) & (document >= 0))
        pair = document[good] * (int(self.name.max()) + 1) + self.name[owner[good]]
        order = np.lexsort((edits[good], pair))
        good, pair = good[order], pair[order]
        new = np.flatnonzero(np.diff(pair, prepend=-1))
        fewest = np.repeat(edits[good[new]], np.diff(new, append=len(pair)))
        good = np.sort(good[edits[good] == fewest])
        begin = end - self.p.length[owner]  # without an edit
        changed = good[edits[good] > 0]
        begin[changed] = self._align(data, owner[changed], low[changed], width, True)[2]
        for x in good.tolist():
            d = int(document[x])
            yield d, int(owner[x]), int(begin[x] - begins[d]), int(end[x] - begins[d]), int(edits[x])

    def _align(self, data: np.ndarray, owner: np.ndarray, low: np.ndarray, width: int, trace: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(edits, end, begin if traced) of each probe along its band, many at
        once: the probe may begin anywhere in the band, and strays at most
        `edits` beyond. Rows are diagonals, columns probes."""
        p = self.p
        pad = p.settings.edits
        wide = width + 2 * pad
        found = np.zeros((3, len(owner)), np.int64)
        for i in range(0, len(owner), _ALIGNED):
            k, b = owner[i : i + _ALIGNED], low[i : i + _ALIGNED]
            n = p.length[k]
            most = int(n.max())
            place = b + np.arange(most + wide)[:, None]
            text = data[np.clip(place, 0, len(data) - 1)]
            text[(place < 0) | (place >= len(data))] = 0
            probe = p.data[np.minimum(p.start[k] + np.arange(most)[:, None], len(p.data) - 1)]
            # cost[j]: edits of the probe's first r bytes against text that ends before b + r + j
            cost = np.zeros((wide, len(k)), np.min_scalar_type(max(most + 2, wide)))
            begin = np.arange(wide, dtype=cost.dtype)[:, None] + np.zeros_like(cost)
            for r in range(most):
                new = cost + (text[r : r + wide] != probe[r])
                start = begin.copy() if trace else begin
                drop = cost[1:] + 1  # the probe's byte is missing in the text
                if trace:
                    start[:-1] = np.where(drop < new[:-1], begin[1:], start[:-1])
                np.minimum(new[:-1], drop, out=new[:-1])
                for _ in range(pad):  # a byte of the text is missing in the probe
                    more = new[:-1] + 1
                    if trace:
                        start[1:] = np.where(more < new[1:], start[:-1], start[1:])
                    np.minimum(new[1:], more, out=new[1:])
                live = r < n
                if live.all():
                    cost, begin = new, start
                else:
                    cost, begin = np.where(live, new, cost), np.where(live, start, begin)
            j, x = cost.argmin(axis=0), np.arange(len(k))
            found[:, i : i + len(k)] = cost[j, x], b + n + j, b + begin[j, x]
        return found[0], found[1], found[2]


def shards(benchmark: DataFrame, chars: int = SHARD_CHARS) -> Iterator[list[tuple[int, bytes]]]:
    """The items (item_id, text) in turn, at most `chars` bytes at once; an item
    without an id or words has nothing to find."""
    held: list[tuple[int, bytes]] = []
    total = 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    for row in rows.toLocalIterator():
        text = row["text"].encode("utf-8", "replace")
        if held and total + len(text) > chars:
            yield held
            held, total = [], 0
        held.append((row["item_id"], text))
        total += len(text)
    if held:
        yield held


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = CORPUS, chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id, begin, end, edits: for every document and item of which
    a probe occurs within its edits, the stretch with the fewest (the first of
    equals), in bytes of the normalised text. Null text counts as empty;
    repeated rows match alike; no benchmark: no rows."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, begin long, end long, edits int"
    found = None
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for items in shards(benchmark, chars):
        sent = spark.sparkContext.broadcast((items, settings))

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = None
            for ids, group in texts(batches, most=1 << 22):
                matcher = matcher or Matcher(Probes.of(*sent.value))
                hits = matcher.match(group)
                columns = [[ids[h[0]] for h in hits], *([h[i] for h in hits] for i in range(1, 5))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                    ["doc_id", "item_id", "begin", "end", "edits"],
                )

        part = rows.mapInArrow(of, schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a passage of the benchmark go. Each
    row is judged by its own text, so ids may be null or repeat."""
    columns = docs.columns
    kept = docs
    for items in shards(table(spark, sf_dir, "benchmark")):
        sent = spark.sparkContext.broadcast((items, CORPUS))

        def of(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            matcher = None
            for batch in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
                matcher = matcher or Matcher(Probes.of(*sent.value))
                numbers = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(columns.index("text")).cast(pa.string())], ["i", "text"])
                hit = {ids[h[0]] for ids, group in texts(iter([numbers]), most=1 << 22) for h in matcher.match(group)}
                yield batch.filter(pa.array([i not in hit for i in range(batch.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(of, docs.schema)
    return kept
