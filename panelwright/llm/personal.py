"""Personal data, plain and disguised.

Plain identifiers are found as they stand. For disguised ones a text runs
through a cascade of transducers that rewrite it: look-alike letters and digits
to ASCII, spelled digits to digits, written-out "at", "dot" and "plus" to their
signs. Each character of the rewritten text knows the stretch of the source
that it came from, so an identifier found there is told by its place in the
source. Each rewriting and each search takes time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, texts

KINDS = ("email", "ip", "card", "phone")

# Cyrillic and Greek letters that look like Latin ones, each pair in turn.
LOOK_ALIKES = (
    "аa еe оo рp сc хx уy іi јj ѕs һh ԁd ԛq ԝw ӏl "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS "
    "αa οo νv ιi κk ρp υu "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
)
# Other signs for @, a dot and a plus.
SIGNS = "﹫@ ․. ﹒. 。. ｡. ﹢+ ⁺+"
# Characters without width.
WIDTHLESS = "­​‌‍⁠﻿"
# The digits from 0 in English, German, Spanish and French.
DIGITS = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
    "zéro un deux trois quatre cinq six sept huit neuf",
)
# The signs' names in these languages.
NAMES = {"@": "at arobase arroba", ".": "dot punkt punto point", "+": "plus más"}
#: So many spelled digits make a run of digits that is rewritten.
SPELLED_LEAST = 3


@cache
def glyphs() -> dict[int, str | None]:
    """Of a character its ASCII letter, digit or sign: full-width and mathematical
    forms and foreign decimal digits by Unicode's own rule, look-alikes by the
    list; None for those without width."""
    found: dict[int, str | None] = {}
    for c in [*range(0xFF01, 0xFF5F), *range(0x1D400, 0x1D800)]:
        plain = unicodedata.normalize("NFKC", chr(c))
        if len(plain) == 1 and plain.isascii():
            found[c] = plain
    for c in range(128, 0x1FBFA):
        if (digit := unicodedata.decimal(chr(c), None)) is not None:
            found[c] = str(digit)
    found |= {ord(pair[0]): pair[1] for pair in f"{LOOK_ALIKES} {SIGNS}".split()}
    return found | dict.fromkeys(map(ord, WIDTHLESS))


@dataclass(frozen=True)
class Tape:
    """A text, and of each of its characters the stretch of the source that it
    stands for; changed: whether it was rewritten."""

    text: str
    begins: np.ndarray
    ends: np.ndarray
    changed: np.ndarray

    @classmethod
    def of(cls, text: str) -> Tape:
        at = np.arange(len(text), dtype=np.int64)
        return cls(text, at, at + 1, np.zeros(len(text), bool))

    def rewritten(self, outputs: list[tuple[int, int, str]]) -> Tape:
        """With each stretch (begin, end, output) in turn replaced. A character of
        the output stands for the whole stretch; a stretch without output is a gap."""
        parts, arrays, at = [], [], 0
        for a, z, out in outputs:
            parts += [self.text[at:a], out]
            arrays.append((self.begins[at:a], self.ends[at:a], self.changed[at:a]))
            if out:
                n = len(out)
                arrays.append((np.full(n, self.begins[a]), np.full(n, self.ends[z - 1]), np.ones(n, bool)))
            at = z
        parts.append(self.text[at:])
        arrays.append((self.begins[at:], self.ends[at:], self.changed[at:]))
        return Tape("".join(parts), *(np.concatenate(column) for column in zip(*arrays, strict=True)))

    def source(self, a: int, z: int) -> tuple[int, int, bool]:
        """Where the stretch lies in the source, and whether anything in it was rewritten or left out."""
        gap = bool((self.begins[a + 1 : z] > self.ends[a : z - 1]).any())
        return int(self.begins[a]), int(self.ends[z - 1]), gap or bool(self.changed[a:z].any())


@dataclass(frozen=True)
class Transducer:
    """Rewrites each match of reads by what writes says; None leaves it as it is."""

    reads: re.Pattern
    writes: Callable[[re.Match], list[tuple[int, int, str]]]

    def __call__(self, tape: Tape) -> Tape:
        outputs = [out for m in self.reads.finditer(tape.text) for out in self.writes(m)]
        return tape.rewritten(outputs) if outputs else tape


def _any(words: str) -> str:
    return "(?:" + "|".join(sorted(map(re.escape, words.split()), key=len, reverse=True)) + ")"


@cache
def _glyph_codes() -> tuple[frozenset[str], np.ndarray, np.ndarray]:
    """(the characters, the sorted codes of those rewritten, of those left out)"""
    to = glyphs()
    return frozenset(map(chr, to)), np.array(sorted(c for c, x in to.items() if x), np.uint32), np.array(sorted(c for c, x in to.items() if not x), np.uint32)


def plain_glyphs(text: str) -> Tape | None:
    """The first transducer, one character at a time; None if it has nothing to do."""
    known, written, left_out = _glyph_codes()
    if text.isascii() or known.isdisjoint(text):
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.flatnonzero(~np.isin(codes, left_out))
    return Tape(text.translate(glyphs()), kept, kept + 1, np.isin(codes, written)[kept])


_VALUE = {word: str(i) for language in DIGITS for i, word in enumerate(language.split())}
_WORD = _any(" ".join(DIGITS))
_EDGE, _STOP = r"(?<![^\W\d_])", r"(?![^\W\d_])"  # no letter before, none after
_DOT, _AT, _PLUS = (_any(NAMES[k]) for k in (".", "@", "+"))
_SPELLED = re.compile(f"{_EDGE}{_WORD}{_STOP}", re.I)
#: Between digits of a run; a name of the dot or the plus may stand there too.
_BETWEEN = rf"(?:[\x20,.()\[\]-]{{1,3}}|\x20?[\[(]?{_EDGE}{_DOT}{_STOP}[\])]?\x20?)?"


def _digits() -> Transducer:
    """Runs of digits with SPELLED_LEAST spelled ones or more. Blanks, hyphens
    and commas between two spelled digits go; other separators stay."""

    def writes(m: re.Match) -> list[tuple[int, int, str]]:
        spelled = [(s.start(), s.end()) for s in _SPELLED.finditer(m.string, m.start(), m.end())]
        if len(spelled) < SPELLED_LEAST:
            return []
        out: list[tuple[int, int, str]] = []
        for a, z in spelled:
            if out and out[-1][1] < a and not m.string[out[-1][1] : a].strip(" ,-"):
                out.append((out[-1][1], a, ""))
            out.append((a, z, _VALUE[m.string[a:z].lower()]))
        return out

    token = rf"(?:{_EDGE}{_WORD}{_STOP}|[0-9]{{1,19}}+)"
    # runs begin with a spelled digit or with digits that one follows
    return Transducer(re.compile(rf"(?<![0-9]){token}(?:{_BETWEEN}{token}){{2,64}}", re.I), writes)


_SPACE = r"[\x20\t]{0,2}"
_SIDE = r"[A-Za-z0-9]"


def _framed(name: str, sign: str) -> str:
    """A sign or its name in brackets, or its name between blanks, underscores or hyphens."""
    return rf"(?:{_SPACE}[\[({{<]{_SPACE}(?:{name}|{sign}){_SPACE}[\])}}>]{_SPACE}|[\x20\t]{{1,2}}{name}[\x20\t]{{1,2}}|_{name}_|-{name}-)"


def _signs() -> list[Transducer]:
    dot = rf"(?:{_framed(_DOT, '[.]')}|[\x20]\.[\x20])"
    bare = rf"(?:[\x20\t]{{1,2}}{_AT}[\x20\t]{{1,2}}|_{_AT}_|-{_AT}-)"
    framed = rf"{_SPACE}[\[({{<]{_SPACE}(?:{_AT}|@){_SPACE}[\])}}>]{_SPACE}"
    one = lambda sign: lambda m: [(m.start(), m.end(), sign)]
    host = rf"{_SIDE}[A-Za-z0-9-]{{0,62}}"
    return [
        Transducer(re.compile(r"&(?:#64|#[xX]40|commat);"), one("@")),
        Transducer(re.compile(r"&(?:#46|#[xX]2[eE]|period);"), one(".")),
        # a name without brackets is an "at" only before a name that has a spelled dot
        Transducer(re.compile(rf"(?<={_SIDE})(?:{framed}(?={host}(?:\.|{dot})){'|'}{bare}(?={host}(?:\.{host}){{0,4}}{dot}{_SIDE}))|(?<={_SIDE})\x20?@\x20?(?={host}(?:\.{_SIDE}|{dot}))", re.I),
                   lambda m: [] if m[0] == "@" else [(m.start(), m.end(), "@")]),
        Transducer(re.compile(rf"(?<={_SIDE}){dot}(?={_SIDE})", re.I), one(".")),
        # the country's digit may be the only one that is spelled
        Transducer(re.compile(rf"{_EDGE}{_PLUS}{_SPACE}(?:(?=\(?[0-9])|({_WORD}){_STOP}(?=[\x20(.-]{{1,2}}[0-9]))", re.I),
                   lambda m: [(m.start(), m.end(), "+" + _VALUE[m[1].lower()])] if m[1] else [(m.start(), m.end(), "+")]),
    ]


@cache
def cascade() -> tuple[Transducer, ...]:
    return (_digits(), *_signs())


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_DIGIT_NAMES = frozenset(word.encode() for word in _VALUE)
_DOT_NAMES, _AT_NAMES, _PLUS_NAMES = (frozenset(NAMES[k].encode().split()) for k in (".", "@", "+"))
_SPEAKING = _DIGIT_NAMES | _DOT_NAMES | _PLUS_NAMES
_FRAMES = re.compile(rf"[\[({{<][\x20\t]{{0,2}}(?:{_AT}|{_DOT}|[@.])[\x20\t]{{0,2}}[\])}}>]|&(?:#|commat;|period;)".encode())


def hinted(text: str) -> bool:
    """Whether the cascade may find anything to rewrite: a cheap test that never misses."""
    raw = text.encode("utf-8", "replace")
    low = raw.lower()
    if b"@" in raw and (b" @" in raw or b"@ " in raw or b" . " in raw) or _FRAMES.search(low):
        return True
    words = raw.translate(_WORDS).split()
    spelled: list[int] = []
    for i in [i for i, w in enumerate(words) if w in _SPEAKING]:
        word, before, after = words[i], words[max(0, i - 8) : i], words[i + 1 : i + 2]
        if word in _DIGIT_NAMES:
            spelled.append(i)
            if len(spelled) >= SPELLED_LEAST and i - spelled[-SPELLED_LEAST] <= 40:
                return True
        elif word in _PLUS_NAMES:
            if after and (after[0][:1].isdigit() or after[0] in _DIGIT_NAMES):
                return True
        elif after and before and (b"@" in raw or not _AT_NAMES.isdisjoint(before) or (before[-1][-1:].isdigit() and after[0][:1].isdigit())):
            return True
    return False


_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_EMAIL = rf"{_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)+"
_EMAIL_HERE, _EMAIL_NEXT = re.compile(_EMAIL), re.compile(rf"(?<!{_LOCAL}){_EMAIL}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"[^0-9]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches that don't overlap. One begins where a run of its
    first part's characters does, or where the match before it ended."""
    at = 0
    while m := (_EMAIL_HERE.match(text, at) or _EMAIL_NEXT.search(text, at)):
        yield m.span()
        at = m.end()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def identifiers(text: str) -> list[tuple[int, str, int]]:
    """The plain identifiers as (start, kind, end), by start, then by kind."""
    found = [(a, "email", z) for a, z in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _OTHER.sub("", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_OTHER.sub("", m[0])) <= 15:
            found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _plausible(text: str, kind: str) -> bool:
    """A disguised address ends in a name of letters."""
    return kind != "email" or (len(last := text.rsplit(".", 1)[1]) >= 2 and last.isalpha())


def disguised(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """The identifiers that only the rewritten text shows, in places of the
    source: those with something rewritten in them, not within a plain one of their kind."""
    tape = plain_glyphs(text)
    if tape is None and not hinted(text):
        return []
    tape = tape or Tape.of(text)
    if tape.text is text or hinted(tape.text):
        for transducer in cascade():
            tape = transducer(tape)
    found = []
    for a, kind, z in identifiers(tape.text):
        begin, end, new = tape.source(a, z)
        if new and _plausible(tape.text[a:z], kind) and not any(k == kind and b <= begin and end <= e for b, k, e in base):
            found.append((begin, kind, end))
    return found


def find_personal(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(plain identifiers, all with the disguised ones) as (start, kind, end) in
    code points, end exclusive, by start and then by kind."""
    base = identifiers(text)
    more = disguised(text, base)
    return base, sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[1]), s[2])) if more else base


def masked(text: str) -> str:
    """text with each identifier, plain or disguised, replaced by `[kind]`; of
    spans that overlap the union, named after the first."""
    parts, end = [], 0
    for a, kind, z in find_personal(text)[1]:
        if a >= end:
            parts += [text[end:a], f"[{kind}]"]
        end = max(end, z)
    return "".join([*parts, text[end:]])


def mask(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with the personal data of a column of text masked; null stays null,
    all other columns stay, whatever their names."""
    at, schema = docs.columns.index(column), docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array((None if x is None else masked(x) for x in batch.column(at).to_pylist()), batch.column(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], [f"c{i}" for i in range(batch.num_columns)])

    numbered = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return numbered.mapInArrow(of, numbered.schema).toDF(*schema.names)


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, k, z in spans)


def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with spans in code points. No columns but doc_id
    and text are read. Null or empty text has no spans; null ids and repeated
    rows have a row each; texts of any length are read whole, in time linear in
    their length. No rows: no rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found in texts(batches):
            spans = [find_personal(x.decode()) for x in found]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in spans], pa.int64()) for k in KINDS]
            sums = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in spans], pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *counts, sums, pa.array([_joined(x) for _, x in spans], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
