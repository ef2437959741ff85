import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import substrings

DOCS = "doc_id long, text string, n_bytes string, source string"


def plain(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("ab é\n") for _ in range(n))
    shared = [text(rng.randint(length // 2, 4 * length)) for _ in range(6)]
    rows = [(i, text(rng.randint(0, 5 * length))) for i in range(20)]
    for i in range(20, 60):
        rows.append((i, "".join(rng.choice([*shared, text(rng.randint(0, length)), shared[0][: length - 1]]) for _ in range(rng.randint(1, 4)))))
    rows += [(60, None), (61, ""), (62, "x" * (length - 1)), (63, "x" * length), (64, "y" * (3 * length)), (65, "abcabcab" * length), (None, shared[1] * 2), (5, rows[5][1]), (66, rows[7][1]), (67, rows[7][1])]
    return rows


@pytest.mark.parametrize("many", [2, 32])
def test_same_as_brute_force(spark, many):
    rows = corpus(many, 24)
    df = spark.createDataFrame([(*r, "clash", "s") for r in rows], DOCS).repartition(3)
    found = sorted(map(tuple, substrings.deduplicate(df, 24, 8, many, block_bytes=1500).collect()), key=str)
    assert found == plain(rows, 24)
    assert sum(r[2] > 0 for r in found) > 20 and sum(r[2] == 0 for r in found) > 5


def test_runs_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(substrings, "_SLICE", 97)
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (0, 5, 30, 200, 31, 30, 29)]
    sizes = np.array([len(t) for t in texts])
    joined = b"".join(texts)
    begin, count, key = substrings.runs(np.frombuffer(joined, np.uint8), sizes, 30, 9)
    got = sorted(b + i for b, n in zip(begin.tolist(), count.tolist(), strict=True) for i in range(n))
    want, at, keys = [], 0, {}
    for t in texts:
        want += range(at, at + len(t) - 29) if len(t) >= 30 else []
        at += len(t)
    assert got == want
    for b, n, k in zip(begin.tolist(), count.tolist(), key.tolist(), strict=True):
        for i in range(b, b + n):  # equal windows have equal keys
            assert keys.setdefault(joined[i : i + 30], k) == k


def test_empty_table(spark):
    assert substrings.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_are_cut_into_runs_once(spark, monkeypatch):
    """What is kept with a block has all of its runs, so lists of runs read no text."""
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 40, 300, 29, 500)]
    joined, sizes = b"".join(texts), np.array([len(t) for t in texts])
    begin, count, key = substrings.runs(np.frombuffer(joined, np.uint8), sizes, 30, 9)
    held = substrings._held(joined, sizes, 30, 9)
    for got, want in zip(substrings._from_held(held), (begin, count), strict=True):
        np.testing.assert_array_equal(got, want)
    found, whole = substrings._hashes(held)
    np.testing.assert_array_equal(found.view(np.uint64), key)
    bodies = [joined[a : a + n + 29] for a, n in zip(begin.tolist(), count.tolist(), strict=True)]
    assert len(set(bodies)) == len(set(whole.tolist())) and len(whole) == len(bodies)
    none = substrings._held(b"", np.array([0]), 30, 9)
    assert substrings._hashes(none).shape == (2, 0) and len(substrings._from_held(none)[0]) == 0
