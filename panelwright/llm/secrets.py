"""Secret scans with one combined deterministic automaton.

Every rule is compiled by Thompson and subset construction into an automaton of
its leftmost matches: behind a head (of known length) it follows one match until
that ends or dies, and takes up no other head meanwhile. The reachable product of
all rules' automata, minimised by partition refinement, is one transition array
of states by byte classes. Its twin, the event array, tells for every transition
which heads end there, and which matches begin to be whole or end. One pass over
the bytes of a batch gives all events of all rules; spans follow from the events
alone, and no byte is read twice.

Texts are cut into lanes behind bytes that no rule has, at which every state
leaves for the start; all lanes advance a byte at a time. What remains of few
long lanes is read byte by byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, texts

_UPPER, _LOWER, _DIGIT = frozenset(range(65, 91)), frozenset(range(97, 123)), frozenset(range(48, 58))
_ALNUM = _UPPER | _LOWER | _DIGIT

# --- rule syntax: small combinators over byte sets ---------------------------


def one(*sets: Iterable[int] | str) -> tuple:
    """One byte of any of the sets or strings."""
    return ("set", frozenset(b for s in sets for b in (s.encode() if isinstance(s, str) else s)))


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def either(*parts: tuple) -> tuple:
    return ("alt", parts)


def maybe(part: tuple) -> tuple:
    return ("alt", (part, seq()))


def some(part: tuple, least: int = 0) -> tuple:
    """`least` or more times."""
    return seq(*[part] * least, ("star", part))


def word(text: str, fold: bool = False) -> tuple:
    return seq(*(one(c.lower(), c.upper()) if fold else one(c) for c in text))


@dataclass(frozen=True)
class Rule:
    """Matches are one of the heads, each of a fixed length, and then rest;
    leftmost, then longest, and not overlapping within a rule. A match counts if
    it has `least` bytes, and `value_least` from where it first is whole. Bytes
    above 127 can't be matched. What `tail` fits behind a match belongs to it.

    Two conditions on rest: once a match is whole, no byte may leave it open but
    not whole; and of heads inside a match that dies, none may go on to match."""

    kind: str
    heads: tuple[tuple, ...]
    rest: tuple
    least: int = 1
    value_least: int = 0
    tail: re.Pattern[bytes] | None = None


_VALUE = one(_ALNUM, "+/_.=-")
_QUOTE, _GAP = maybe(one("\"'")), some(one(" "))
_KEYS = tuple(word(k, True) for k in ("password", "passwd", "secret", "token", "apikey", "api_key"))
_URLSAFE = one(_ALNUM, "_-")
_HEX = one(_DIGIT, "abcdef")

#: Of a private key, behind its BEGIN line: all up to the END line; without one
#: (cut off), header lines and the base64 run, with line breaks as such or escaped.
_EOL = rb"(?:[ \t\"'+,]*+(?:\r\n?|\n|(?:\\r)?\\n)[ \t>\"'#*|]*+)"
_KEY_BODY = re.compile(
    rb"(?:(?!-----)[\x09-\x0d\x20-\x7e])*-----END [A-Z ]*PRIVATE KEY-----"
    rb"|(?:" + _EOL + rb"+[A-Za-z0-9-]+: [\x20-\x7e]*(?=[\r\n]))*"
    rb"(?:" + _EOL + rb"+[A-Za-z0-9+/]{16,}={0,2}|[ \t]+[A-Za-z0-9+/]{40,}={0,2})(?:(?:" + _EOL + rb"|[ \t])++[A-Za-z0-9+/]{16,}={0,2})*(?:" + _EOL + rb"+[A-Za-z0-9+/]+={0,2}(?=[ \t]*(?:[\r\n\\\"']|\Z)))?"
    rb"|[A-Za-z0-9+/]{64,}={0,2}"
)

#: The three base kinds, in the order in which equal starts are listed, then the added ones.
RULES = (
    Rule("assign", _KEYS, seq(_QUOTE, _GAP, one(":="), _GAP, _QUOTE, some(_VALUE, 1)), value_least=6),
    Rule("access", (word("AKIA"),), some(one(_UPPER, _DIGIT), 1), least=20),
    Rule("hex", (seq(*[_HEX] * 24),), some(_HEX), least=24),
    Rule("forge", (seq(word("gh"), one("pousr"), word("_")),), some(one(_ALNUM), 1), least=40),
    Rule("chat", (seq(word("xox"), one("abprs"), word("-")),), some(one(_ALNUM, "-"), 1), least=15),
    Rule("cloud", (word("AIza"),), some(_URLSAFE, 1), least=39),
    Rule("jwt", (word("eyJ"),), seq(some(_URLSAFE, 1), word("."), word("eyJ"), some(_URLSAFE, 1), word("."), some(_URLSAFE, 1)), least=40),
    Rule("pem", (word("-----BEGIN "),), seq(some(one(_UPPER, " ")), word("PRIVATE KEY-----")), tail=_KEY_BODY),
)

# --- automata ----------------------------------------------------------------


class _Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node: tuple, start: int) -> int:
        """Adds node from start; returns its end state."""
        kind, body = node
        if kind == "set":
            end = self.state()
            here = self.state()
            self.empty[start].append(here)
            self.moves[here] = (body, end)
            return end
        if kind == "seq":
            for part in body:
                start = self.add(part, start)
            return start
        end = self.state()
        if kind == "alt":
            for part in body:
                here = self.state()
                self.empty[start].append(here)
                self.empty[self.add(part, here)].append(end)
            return end
        loop = self.state()
        self.empty[start] += [loop]
        self.empty[self.add(body, loop)].append(loop)
        self.empty[loop].append(end)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return frozenset(found)


def _length(node: tuple) -> int:
    """Bytes that node matches, which must be the same for all its matches."""
    kind, body = node
    if kind == "set":
        return 1
    if kind == "seq":
        return sum(map(_length, body))
    found = set(map(_length, body)) if kind == "alt" else set()
    if len(found) != 1:
        raise ValueError("a head must have a fixed length")
    return found.pop()


@dataclass(frozen=True)
class Automaton:
    """classes: byte -> class; moves and events: (states, classes). State 0 is
    the start. Bits of an event are numbered as in `bits`: (what, rule, length of
    the head), what being `head`, `whole` or `end`."""

    classes: np.ndarray
    moves: np.ndarray
    events: np.ndarray
    bits: list[tuple[str, int, int]]


def _rule_automaton(rule: Rule, samples: list[int]) -> tuple[np.ndarray, dict[tuple[str, int], np.ndarray]]:
    """moves (states, samples), and for each kind of event where it occurs."""
    nfa = _Nfa()
    starts, heads, join = [], {}, nfa.state()
    for node in rule.heads:
        starts.append(nfa.state())
        heads[nfa.add(node, starts[-1])] = _length(node)
    whole = nfa.add(rule.rest, join)
    fresh, opened = nfa.closure(starts), nfa.closure([join])

    def step(states: frozenset[int], byte: int) -> frozenset[int]:
        return nfa.closure({m[1] for x in states if (m := nfa.moves[x]) and byte in m[0]})

    # a state: the open match's states, and those of the heads in progress
    ids, todo, rows = {(frozenset(), frozenset()): 0}, [(frozenset(), frozenset())], []
    found: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for i, (match, progress) in enumerate(todo):
        row = []
        for c, byte in enumerate(samples):
            after, ahead = step(match, byte), step(progress | fresh, byte)
            if whole in match and whole not in after:
                if after:
                    raise ValueError("a whole match may only be continued or left")
                found.setdefault(("end", 0), []).append((i, c))
                ahead = step(fresh, byte)  # what has begun inside the match overlaps it
            if not after and (ended := [n for x, n in heads.items() if x in ahead]):
                after = opened
                found.setdefault(("head", max(ended)), []).append((i, c))
            if whole in after and (whole not in match or after is opened):
                found.setdefault(("whole", 0), []).append((i, c))
            reached = (after, frozenset() if whole in after else ahead.difference(heads))
            if reached not in ids:
                ids[reached] = len(ids)
                todo.append(reached)
            row.append(ids[reached])
        rows.append(row)
    moves = np.array(rows, np.int64)
    told = {}
    for what, places in found.items():
        told[what] = np.zeros(moves.shape, bool)
        told[what][tuple(np.array(places).T)] = True
    return moves, told


def compile_automaton(rules: tuple[Rule, ...]) -> Automaton:
    """The minimal automaton of all rules."""
    # bytes that every byte set treats alike form one class
    sets = list({x for rule in rules for node in (*rule.heads, rule.rest) for x in _sets(node)})
    signs = [tuple(b in s for s in sets) for b in range(256)]
    order = {s: i for i, s in enumerate(dict.fromkeys(signs))}
    classes = np.array([order[s] for s in signs], np.uint8)
    parts = [_rule_automaton(rule, [signs.index(s) for s in order]) for rule in rules]
    # the reachable product, its states numbered as they are met; a code has each rule's state
    radix = np.cumprod([1, *(len(m) for m, _ in parts)])[:-1]
    split = lambda codes: [codes // r % len(m) for r, (m, _) in zip(radix, parts, strict=True)]
    codes, layers, frontier = np.zeros(1, np.int64), [], np.zeros(1, np.int64)
    while len(frontier):
        reached = sum(m[of] * r for r, (m, _), of in zip(radix, parts, split(frontier), strict=True))
        layers.append(reached)
        frontier = np.setdiff1d(reached, codes)
        codes = np.concatenate([codes, frontier])
    by_code = np.argsort(codes)
    moves = by_code[np.searchsorted(codes[by_code], np.concatenate(layers))]
    bits = [(what, k, n) for k, (_, told) in enumerate(parts) for what, n in told if what != "whole" or rules[k].value_least]
    if len(bits) > 64:
        raise ValueError("too many rules")
    events = np.zeros(moves.shape, np.uint64)
    own = split(codes)
    for j, (what, k, n) in enumerate(bits):
        events |= parts[k][1][what, n][own[k]].astype(np.uint64) << np.uint64(j)
    # minimisation: refine the partition by what states tell until the moves agree
    block = _blocks(events)
    while True:
        finer = _blocks(np.column_stack([block, block[moves]]))
        if finer.max() == block.max():
            break
        block = finer
    first = np.sort(np.unique(block, return_index=True)[1])  # the start, met first, stays state 0
    number = np.empty(len(first), np.int32)
    number[block[first]] = np.arange(len(first))
    return Automaton(classes, number[block[moves[first]]], events[first], bits)


def _sets(node: tuple) -> list[frozenset[int]]:
    kind, body = node
    if kind == "set":
        return [body]
    return _sets(body) if kind == "star" else [x for part in body for x in _sets(part)]


def _blocks(rows: np.ndarray) -> np.ndarray:
    """The number of each row among the distinct ones."""
    whole = np.ascontiguousarray(rows)
    return np.unique(whole.view(np.dtype((np.void, whole.itemsize * whole.shape[1]))).reshape(-1), return_inverse=True)[1].reshape(-1)


#: Lanes below which each is read by itself.
_FEW = 64


class Scanner:
    """The transition and event arrays of rules; made once, on the driver."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        made = compile_automaton(rules)
        self.rules, self.bits, self.states = rules, made.bits, len(made.moves)
        self.classes = made.classes
        self.flat = np.ascontiguousarray(made.moves * made.moves.shape[1]).ravel()
        self.events = made.events.ravel().astype(np.uint32 if len(made.bits) <= 32 else np.uint64)
        # bytes at which every state leaves for the start
        self.resets = (made.moves == 0).all(axis=0)[made.classes]

    def scan(self, data: np.ndarray, lanes: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """(positions, transitions) with events, by position. The last byte must be a reset."""
        n = len(data)
        after = np.flatnonzero(self.resets[data]) + 1
        wanted = np.linspace(0, n, max(1, min(lanes, n // 64)) + 1, dtype=np.int64)[1:-1]
        begins = np.unique(np.append(0, after[np.searchsorted(after, wanted)]))
        begins = begins[begins < n]
        sizes = np.diff(np.append(begins, n))
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        classes = self.classes[data]
        state = np.zeros(len(begins), np.int32)
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        found_at, found = [], []
        at = begins.copy()
        for step in range(int(sizes[0])):
            k = int(live[step])
            if k < _FEW:
                for lane in range(k):
                    self._alone(classes, int(at[lane]), int(begins[lane] + sizes[lane]), int(state[lane]), found_at, found)
                break
            here = at[:k]
            move = state[:k] + classes[here]
            told = self.events[move]
            state[:k] = self.flat[move]
            if told.any():
                hits = np.flatnonzero(told)
                found_at.append(here[hits])
                found.append(move[hits])
            at[:k] += 1
        if not found_at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places, moves = np.concatenate(found_at), np.concatenate(found)
        order = np.argsort(places, kind="stable")
        return places[order], moves[order]

    def _alone(self, classes: np.ndarray, at: int, end: int, state: int, found_at: list, found: list) -> None:
        flat, events = _as_lists(self)
        places, moves = [], []
        for i, c in enumerate(classes[at:end].tobytes(), at):
            move = state + c
            state = flat[move]
            if events[move]:
                places.append(i)
                moves.append(move)
        found_at.append(np.array(places, np.int64))
        found.append(np.array(moves, np.int64))

    def spans(self, joined: bytes, begins: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, start, rule, end) in bytes of joined, from the events of one pass."""
        n = len(self.rules)
        begun, whole, last = [-1] * n, [-1] * n, [0] * n
        out = []
        places, moves = self.scan(np.frombuffer(joined, np.uint8))
        # at one byte a match ends before the next one's head does
        known, which = np.unique(self.events[moves], return_inverse=True)
        kinds = [sorted((("end", "head", "whole").index(what), k, m) for j, (what, k, m) in enumerate(self.bits) if told >> j & 1) for told in known.tolist()]
        for at, told in zip(places.tolist(), which.tolist(), strict=True):
            for what, k, m in kinds[told]:
                if what == 2:
                    whole[k] = at
                elif what == 1:
                    begun[k] = at + 1 - m
                elif begun[k] >= last[k]:
                    a, z, rule = begun[k], at, self.rules[k]
                    if z - a >= rule.least and (not rule.value_least or z - whole[k] >= rule.value_least):
                        doc = int(np.searchsorted(begins, a, side="right")) - 1
                        if rule.tail and (more := rule.tail.match(joined, z, int(ends[doc]))):
                            z = more.end()
                        out.append((doc, a, k, z))
                    last[k] = z
        return sorted(out)


@lru_cache(maxsize=2)
def _as_lists(scan: Scanner) -> tuple[list[int], list[int]]:
    return scan.flat.tolist(), scan.events.tolist()


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(found: list[bytes], rules: tuple[Rule, ...] = RULES, scan: Scanner | None = None) -> list[list[tuple[int, str, int]]]:
    """Of each UTF-8 text its (start, kind, end) in code points, end exclusive,
    by start and then by the rules' order. Texts don't touch: an end of text
    ends every match. scan: the rules' scanner, if it is at hand."""
    scan = scan or scanner(rules)
    joined = b"\n".join(found) + b"\n"
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begins = np.cumsum(sizes + 1) - sizes - 1
    out: list[list[tuple[int, str, int]]] = [[] for _ in found]
    if not found or not (spans := scan.spans(joined, begins, begins + sizes)):
        return out
    # code points before each byte
    points = np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
    points -= points[0]
    for doc, a, k, z in spans:
        base = int(points[begins[doc]])
        out[doc].append((int(points[a]) - base, scan.rules[k].kind, int(points[z]) - base))
    return out


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, k, z in spans)


_BASE = ("assign", "access", "hex")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with spans in code points. No columns but doc_id
    and text are read. Null or empty text has no spans; null ids and repeated
    rows have a row each; texts of any length are read whole, in time linear in
    their bytes. No rows: no rows."""
    scan = spark.sparkContext.broadcast(scanner(RULES))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in texts(batches):
            spans = find_secrets(found, scan=scan.value)
            base = [[s for s in x if s[1] in _BASE] for x in spans]
            counts = [pa.array([sum(s[1] == k for s in x) for x in base], pa.int64()) for k in _BASE]
            sums = [hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *counts, pa.array(sums, pa.string()), pa.array(map(_joined, spans), pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(of, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every secret's span is replaced by `[kind]`; of spans
    that overlap, the union is replaced, named after the first. No document
    goes; n_chars follows the new text; null text stays null."""
    columns, scan = docs.columns, spark.sparkContext.broadcast(scanner(RULES))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(columns.index("text")).to_pylist()
            changed = list(found)
            raw = [(x or "").encode("utf-8", "replace") for x in found]
            step = max(1, len(raw) * (1 << 23) // max(1, sum(map(len, raw))))
            for i in range(0, len(raw), step):
                for j, spans in enumerate(find_secrets(raw[i : i + step], scan=scan.value), i):
                    if spans:
                        changed[j] = blank(found[j], spans)
            arrays = list(batch.columns)
            arrays[columns.index("text")] = pa.array(changed, batch.schema.field("text").type)
            if "n_chars" in columns:
                kind = batch.schema.field("n_chars").type
                was = batch.column(columns.index("n_chars")).to_pylist()
                arrays[columns.index("n_chars")] = pa.array([n if a is b else len(b) for n, a, b in zip(was, found, changed, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return docs.mapInArrow(of, docs.schema)


def blank(text: str, spans: list[tuple[int, str, int]]) -> str:
    """text with the union of spans (by start) replaced by `[kind]`."""
    parts, end = [], 0
    for a, kind, z in spans:
        if a >= end:
            parts += [text[end:a], f"[{kind}]"]
        end = max(end, z)
    return "".join([*parts, text[end:]])
