import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from panelwright.llm import mixing

DOCS = "doc_id long, source string, text string, place string, mix_x string"


def brute(blocks, weights):
    """(phase, source, block) slot by slot: of the released blocks the one with the earliest deadline."""
    left, done, out, phase = {s: n for s, n in blocks.items() if n}, Counter(), [], 0
    while left:
        total = sum(Fraction(weights[s]) for s in left)
        share = {s: Fraction(weights[s]) / total for s in left}
        had, slot = Counter(), 0
        while all(had[s] < n for s, n in left.items()):
            ready = [(math.ceil((had[s] + 1) / w), s) for s, w in share.items() if math.floor(had[s] / w) <= slot]
            due, s = min(ready)
            assert due > slot
            out.append((phase, s, done[s] + had[s]))
            had[s] += 1
            slot += 1
            # the deviation from the unrounded weights, at all times
            assert all(abs(had[x] - w * slot) < 1 for x, w in share.items())
        for s in list(left):
            done[s] += had[s]
            left[s] -= had[s]
            if not left[s]:
                del left[s]
        phase += 1
    return out


def planned(blocks, weights, slots):
    return [(i, s, k) for i, p in enumerate(mixing.phases(blocks, weights, slots)) for r, had in enumerate(p.had) for s, k in p.dealt(r, had)]


@pytest.mark.parametrize("seed", range(20))
def test_schedule_against_brute_force(seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(rng.randint(1, 12))]
    weights = {s: rng.choice([0.01, 1, 5, 100]) * rng.random() + 1e-6 for s in names}
    blocks = {s: rng.choice([0, 1, 3, 40, 200]) for s in names}
    assert planned(blocks, weights, rng.choice([1, 7, 64, 5000])) == brute(blocks, weights)


def test_ten_thousand_to_one_over_many_rounds():
    weights = {"a": 10_000.0, "b": 1.0}
    found = planned({"a": 200_000, "b": 100}, weights, 1024)
    had = Counter()
    for t, (_, s, _) in enumerate(found[:200_000], 1):
        had[s] += 1
        assert abs(had["b"] - Fraction(t, 10_001)) < 1
    assert t / 1024 > 100 and had["b"] in (19, 20)


def test_weights_are_checked():
    assert mixing.phases({}, {}) == []
    for bad in (0.0, -1.0, math.inf, math.nan):
        with pytest.raises(ValueError):
            mixing.phases({"a": 3, "b": 3}, {"a": 1.0, "b": bad})


def test_mix_deals_every_document(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None]), "t", "clash", "clash") for i in range(700)] + [(None, "a", None, None, None)] * 2 + [(5, "b", "t", "x", "y")] * 3
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    weights = {"a": 2.0, "b": 1.0, "c": 1.0, "": 1.0}
    found = mixing.mix(df, weights, block=4, slots=16).collect()
    assert Counter(map(str, (r.doc_id for r in found))) == Counter(map(str, (r[0] for r in rows)))
    assert len({r.mix_position for r in found}) == len(rows)
    sizes = Counter(r[1] or "" for r in rows)
    want = brute({s: -(-n // 4) for s, n in sizes.items()}, weights)
    got = []
    for r in sorted(found, key=lambda r: r.mix_position):
        assert r.mix_position // 4 == r.mix_slot
        if not got or got[-1] != (r.mix_phase, r.source or "", r.mix_block):
            got.append((r.mix_phase, r.source or "", r.mix_block))
    assert got == want
    per_block = Counter((r.source or "", r.mix_block) for r in found)
    assert all(n == min(4, sizes[s] - 4 * k) for (s, k), n in per_block.items())


def test_clashing_names(spark):
    names = ["size", "phase", "begin", "mix_block", "Slot", "low", "high", "share", "k", "s", "s2", "block", "of mix", "hash of mix", "a.b", "mix_position"]
    schema = "doc_id long, source string, " + ", ".join(f"`{n}` string" for n in names)
    df = spark.createDataFrame([(i, "xy"[i % 2], *names) for i in range(40)], schema)
    found = mixing.mix(df, block=4)
    assert found.columns == ["doc_id", "source", *(n for n in names if n not in mixing.MIX_COLUMNS), *mixing.MIX_COLUMNS]
    plain = mixing.mix(df.select("doc_id", "source"), block=4)
    same = [sorted((r.doc_id, r.mix_block, r.mix_position) for r in x.collect()) for x in (found, plain)]
    assert same[0] == same[1] and found.first()["a.b"] == "a.b"


def test_same_order_whatever_the_partitions_and_empty(spark):
    rows = [(i, f"s{i % 3}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    one, two = (sorted(map(tuple, mixing.mix(x).collect())) for x in (df, df.repartition(7)))
    assert one == two
    assert mixing.mix(df.limit(0)).count() == 0


def test_rounds_are_dealt_by_executors(spark):
    blocks, weights = {"a": 300, "b": 170, "c": 9}, {"a": 1.3, "b": 0.7, "c": 0.011}
    found = sorted((r.slot, r.phase, r.s, r.block) for r in mixing._dealt(spark, mixing.phases(blocks, weights, 16)).collect())
    assert found == [(t, *x) for t, x in enumerate(brute(blocks, weights))]
