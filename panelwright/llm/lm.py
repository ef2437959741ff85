"""Language-model scoring by a weighted backoff automaton.

The model of order n smooths each context with its shorter one (a Dirichlet
prior of `prior` pseudo-counts): p(w | h) = (c(hw) + prior p(w | h')) / (c(h) + prior),
down to unigrams with half a count more each. As an automaton: contexts are
states; a trained n-gram is an arc with its log-probability; every other token
takes the state's failure arc, of weight log10(prior / (c(h) + prior)), to the
shorter context. One left-to-right traversal of a text carries the state and
adds up the weights.

The counts of a large corpus fit no executor, so they are never gathered.
Texts are packed into blocks; each block sends its distinct n-grams (as 64-bit
hashes, with its own training counts) to shards by hash, where counts are summed
over all blocks, and gets back the totals of just those n-grams. From these it
builds the part of the automaton that its texts can reach, which gives the same
scores as the whole. A shard holds each block's n-gram once, however frequent
it is, so frequent words and contexts make no hot shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import partitions, stage, table
from .blocks import BLOCK_BYTES, dropped, ids_of, packed, unpack

#: n-grams of all blocks that one shard may hold, on average.
SHARD_GRAMS = 4_000_000
_END, _START = b" ", b"\t"  # no word holds white space
_LANE = 256


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _planes(values: np.ndarray) -> bytes:
    """Integers by bytes of equal weight, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _from_planes(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).reshape(-1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _unigram(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) | 1


_START_GRAM = _unigram(_START)


@dataclass(frozen=True)
class Grams:
    """The n-grams of a block: `hashes` are its distinct ones, sorted (odd:
    unigrams); at[k - 1][i] is the number of the k-gram that ends at token i of
    the block (-1 where the text has too few before it). Each text is its words
    between a start and an end token; `first` has each text's start token."""

    hashes: np.ndarray
    at: list[np.ndarray]
    first: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(found: list[bytes], order: int) -> Grams:
        number: dict[bytes, int] = {_START: 0, _END: 1}
        tokens: list[int] = []
        sizes = np.zeros(len(found), np.int64)
        for i, text in enumerate(found):
            words = text.lower().split()
            tokens.append(0)
            tokens += [number.setdefault(w, len(number)) for w in words]
            tokens.append(1)
            sizes[i] = len(words) + 2
        local = np.array(tokens, np.int64)
        words = np.fromiter(map(_unigram, number), np.uint64, len(number))
        first = np.cumsum(sizes) - sizes
        place = np.arange(len(local)) - np.repeat(first, sizes)
        made = [words[local]] if len(local) else [np.empty(0, np.uint64)]
        for k in range(2, order + 1):
            grown = np.zeros(len(local), np.uint64)
            # the k-gram from its first token and the (k - 1)-gram that follows it
            grown[k - 1 :] = _mixed(made[0][: len(local) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + made[-1][k - 1 :] + np.uint64(2 * k)) & ~np.uint64(1)
            made.append(grown)
        valid = [place >= k for k in range(order)]
        hashes, back = np.unique(np.concatenate([m[v] for m, v in zip(made, valid, strict=True)]), return_inverse=True)
        at, used = [], 0
        for v in valid:
            x = np.full(len(local), -1, np.int64)
            n = int(v.sum())
            x[v] = back[used : used + n]
            used += n
            at.append(x)
        return Grams(hashes, at, first, sizes)

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often each n-gram occurs in the chosen texts (a mask)."""
        mask = np.repeat(chosen, self.sizes)
        total = np.zeros(len(self.hashes), np.int64)
        for x in self.at:
            total += np.bincount(x[mask & (x >= 0)], minlength=len(self.hashes))
        return total


class Automaton:
    """The states and arcs that a block's texts can reach. totals: the training
    count of each n-gram of the block; tokens, types: of the training texts."""

    def __init__(self, grams: Grams, totals: np.ndarray, tokens: int, types: int, prior: float) -> None:
        order = len(grams.at)
        n = len(grams.hashes)
        self.grams, self.order = grams, order
        # of each n-gram: its last token, the n-gram without its last token (its context), and without its first
        size = np.zeros(n, np.int64)
        last, context, suffix = (np.full(n, -1, np.int64) for _ in range(3))
        for k, x in enumerate(grams.at):
            here = np.flatnonzero(x >= 0)
            size[x[here]], last[x[here]] = k + 1, grams.at[0][here]
            if k:
                context[x[here]], suffix[x[here]] = grams.at[k - 1][here - 1], grams.at[k - 1][here]
        self.floor = np.log10((totals + 0.5) / (tokens + 0.5 * (types + 1)))
        p = 10.0**self.floor
        for k in range(2, order + 1):
            g = np.flatnonzero(size == k)
            c = totals[context[g]]
            p[g] = (totals[g] + prior * p[suffix[g]]) / (c + prior)
        # states: the empty context (0), then trained n-grams short enough to be one;
        # state_of: the state after an n-gram, that of its longest end that is one
        held = np.flatnonzero((size < order) & (totals > 0))
        state_of = np.zeros(n, np.int64)
        state_of[held] = np.arange(1, len(held) + 1)
        for k in range(2, order + 1):
            g = np.flatnonzero((size == k) & (state_of == 0))
            state_of[g] = state_of[suffix[g]]
        self.state_of = state_of
        self.fail = np.zeros(len(held) + 1, np.int64)
        self.fail_weight = np.zeros(len(held) + 1)
        longer = held[size[held] > 1]
        self.fail[state_of[longer]] = state_of[suffix[longer]]
        self.fail_weight[state_of[held]] = np.log10(prior / (totals[held] + prior))
        # arcs of trained n-grams, by (state, token); those of the empty context by token
        arcs = np.flatnonzero((size > 1) & (totals > 0))
        key = state_of[context[arcs]] * n + last[arcs]
        by_key = np.argsort(key, kind="stable")
        self.arc_key, arcs = key[by_key], arcs[by_key]
        self.arc_weight, self.arc_next = np.log10(p[arcs]), state_of[arcs]
        self.totals = totals

    def scores(self) -> np.ndarray:
        """log10 probability of each text, by one traversal. Long texts are cut
        into lanes: the state is fixed by the last order - 1 tokens, so a lane
        that reads these first, without counting them, carries the same state."""
        g, n = self.grams, len(self.grams.hashes)
        token = g.at[0]
        warm = self.order - 1
        lanes = -(-(g.sizes - 1) // _LANE)
        doc = np.repeat(np.arange(len(g.sizes)), lanes)
        part = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = g.first[doc] + 1 + part * _LANE
        end = np.minimum(begin + _LANE, (g.first + g.sizes)[doc])
        at = np.maximum(begin - warm, g.first[doc])
        # a lane at the start of its text begins in the state of the start token
        state = np.zeros(len(doc), np.int64)
        by_size = np.argsort(-(end - at), kind="stable")
        doc, begin, end, at, state = (x[by_size] for x in (doc, begin, end, at, state))
        length = end - at
        total = np.zeros(len(doc))
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        for step in range(len(live)):
            k = int(live[step])
            place = at[:k] + step
            w = token[place]
            s = state[:k].copy()
            gained = np.zeros(k)
            todo = np.arange(k)
            if len(self.arc_key):
                todo = np.flatnonzero(s)
                done = np.flatnonzero(s == 0)
                while len(todo):
                    key = s[todo] * n + w[todo]
                    arc = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
                    hit = self.arc_key[arc] == key
                    x = todo[hit]
                    gained[x] += self.arc_weight[arc[hit]]
                    s[x] = self.arc_next[arc[hit]]
                    x = todo[~hit]
                    gained[x] += self.fail_weight[s[x]]
                    s[x] = self.fail[s[x]]
                    done = np.concatenate([done, x[s[x] == 0]])
                    todo = x[s[x] != 0]
                todo = done
            else:  # no trained n-gram but unigrams
                while (x := np.flatnonzero(s)).size:
                    gained[x] += self.fail_weight[s[x]]
                    s[x] = self.fail[s[x]]
            gained[todo] += self.floor[w[todo]]
            s[todo] = self.state_of[w[todo]] if self.order > 1 else 0
            state[:k] = s
            total[:k] += np.where(place >= begin[:k], gained, 0.0)
        return np.bincount(doc, total, len(g.sizes))


_ANSWER = "block long, shard long, totals binary, tokens long, types long"


def score_documents(docs: DataFrame, order: int = 2, prior: float = 8.0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of every row of docs (doc_id, text), by a model of the rows that aren't held
    out. Null and empty texts are an end token. A null id trains; repeated rows
    train and score each for itself. No rows: no rows."""
    spark = docs.sparkSession
    with dropped(spark, packed(docs, block_bytes)) as blocks:
        return _scored(blocks.drop("extra"), order, prior, block_bytes)


def _scored(blocks: DataFrame, order: int, prior: float, block_bytes: int) -> DataFrame:
    spark = blocks.sparkSession
    n_blocks = blocks.select("block").count()
    shards = max(partitions(spark), -(-n_blocks * (block_bytes // 6) // SHARD_GRAMS))

    def cuts(hashes: np.ndarray) -> list[int]:
        """Where each shard's hashes begin, of sorted ones."""
        edges = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
        return [0, *np.searchsorted(hashes, edges).tolist(), len(hashes)]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, known, sizes, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = Grams.of(unpack(sizes, text), order)
                train = np.array([not is_held_out(k) for k in ids_of(ids, known)], bool)
                counts = grams.counts(train).astype(np.uint32)
                at = cuts(grams.hashes)
                rows = [(s, block, _planes(np.diff(grams.hashes[a:z], prepend=np.uint64(0))), _planes(counts[a:z])) for s, (a, z) in enumerate(zip(at, at[1:], strict=False)) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "block", "hashes", "counts"])

    def answer(asked: pa.Table) -> pa.Table:
        shard = asked["shard"][0].as_py()
        hashes = [np.cumsum(_from_planes(x, np.uint64), dtype=np.uint64) for x in asked["hashes"].to_pylist()]
        counts = np.concatenate([_from_planes(x, np.uint32) for x in asked["counts"].to_pylist()])
        found, back = np.unique(np.concatenate(hashes), return_inverse=True)
        totals = np.bincount(back, counts, len(found)).astype(np.uint64)
        words = (found & np.uint64(1) == 1) & (found != np.uint64(_START_GRAM))
        rows = [(-1, shard, None, int(totals[words].sum()), int((totals[words] > 0).sum()))]
        ends = np.cumsum([len(x) for x in hashes]).tolist()
        for block, a, z in zip(asked["block"].to_pylist(), [0, *ends[:-1]], ends, strict=True):
            rows.append((block, shard, _planes(totals[back[a:z]]), 0, 0))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["block", "shard", "totals", "tokens", "types"])

    asked = blocks.mapInArrow(ask, "shard long, block long, hashes binary, counts binary")
    answers = stage(asked.groupBy("shard").applyInArrow(answer, _ANSWER), "answers")
    tokens, types = answers.where("block = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    by_block = answers.where("block >= 0").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "totals"))).alias("parts"))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, known, sizes, text, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = Grams.of(unpack(sizes, text), order)
                totals = np.concatenate([_from_planes(p["totals"], np.uint64) for p in parts]).astype(np.int64)
                automaton = Automaton(grams, totals, tokens, types, prior)
                keys = ids_of(ids, known)
                counted = np.ones(len(grams.at[0]), bool)
                counted[grams.first] = False
                doc = np.repeat(np.arange(len(keys)), grams.sizes)[counted]
                unigrams = grams.at[0][counted]
                columns = [
                    pa.array(keys, pa.int64()),
                    pa.array([is_held_out(k) for k in keys], pa.bool_()),
                    pa.array(grams.sizes - 1),
                    pa.array(np.bincount(doc, totals[unigrams] > 0, len(keys)).astype(np.int64)),
                    pa.array(np.full(len(keys), tokens, np.int64)),
                    pa.array(np.bincount(doc, automaton.floor[unigrams], len(keys))),
                    pa.array(automaton.scores()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    joined = blocks.join(by_block, "block").select("ids", "known", "sizes", "text", "parts")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return stage(joined.mapInArrow(traverse, schema), "scores")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
