import math
import random

import pytest
from pyspark.sql import functions as F

from panelwright.config import SelectionConfig
from panelwright.operators import metrics as mt
from panelwright.operators.screening import greedy_selection
from panelwright.operators.selection import constrained_top_k


def greedy(rows, c, previous):
    """The loop that the plan replaces."""
    cap, buffer = max(1, math.ceil(c.top_k * c.max_industry_fraction)), math.ceil(c.top_k * c.buffer_exit_multiplier)
    rows = sorted(rows, key=lambda r: r[3])
    order = [(r, "buffer_keep") for r in rows if r[1] in previous and r[3] <= buffer]
    order += [(r, "new_top_rank") for r in rows if not (r[1] in previous and r[3] <= buffer)]
    out, used = [], {}
    for r, why in order:
        if len(out) < c.top_k and used.get(r[2], 0) < cap:
            used[r[2]] = used.get(r[2], 0) + 1
            out.append((r[1], why))
    taken = {k for k, _ in out}
    out += [(r[1], "industry_cap_relaxed") for r in rows if r[1] not in taken]
    return out[: c.top_k]


def test_same_as_the_greedy_loop(spark):
    rng = random.Random(8)
    rows, cases = [], {}
    c = SelectionConfig(top_k=7, max_industry_fraction=0.3, buffer_exit_multiplier=1.5)
    for case in range(300):
        n = rng.randint(0, 25)
        ranks = list(range(1, n + 1))
        rng.shuffle(ranks)
        mine = [(case, f"{i:06d}", rng.choice("abcd"[: rng.randint(1, 4)]), ranks[i]) for i in range(n)]
        held = {f"{i:06d}" for i in range(25) if rng.random() < 0.3}
        cases[case] = greedy(mine, c, held)
        rows += [(*r, r[1] in held) for r in mine]
    df = spark.createDataFrame(rows, "date int, code string, industry string, global_rank int, held boolean")
    got = {}
    for r in constrained_top_k(df, c, F.col("held")).orderBy("date", "candidate_position").collect():
        got.setdefault(r.date, []).append((r.code, r.selection_reason))
    assert {k: v for k, v in cases.items() if v} == got


def test_newey_west_by_hand(spark):
    x = [0.1, -0.2, 0.3, 0.05, 0.4, -0.1]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(x)] + [("g", 0, 0.5)], "feature string, date int, ic double")
    got = {r.feature: r.ic_tstat for r in mt.newey_west(df, 2).collect()}
    n, m = len(x), sum(x) / len(x)
    d = [v - m for v in x]
    v = sum(a * a for a in d) / n + 2 * sum((1 - k / 3) * sum(d[i] * d[i - k] for i in range(k, n)) / n for k in (1, 2))
    assert got["f"] == pytest.approx(m / math.sqrt(v / n)) and got["g"] is None


def test_turnover_sharpe_and_metrics(spark):
    held = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (1, "d"), (2, "x")], "period int, code string")
    assert {r.period: r.turnover for r in mt.turnover(held).collect()} == {0: None, 1: pytest.approx(2 / 3), 2: 1.0}
    returns = spark.createDataFrame([(0.1,), (0.2,), (None,)], "x double")
    assert returns.agg(mt.sharpe(5, F.col("x")).alias("s")).first().s == pytest.approx(0.15 / (0.1 / math.sqrt(2)) * math.sqrt(252 / 5))
    assert returns.limit(1).agg(mt.sharpe(5, F.col("x")).alias("s")).first().s is None
    b = spark.createDataFrame([(1, 0.1, 0.2, 0.4), (1, None, None, None), (1, 0.3, -0.1, 0.1)], "date int, forward_return double, target_excess_return double, target_rank double")
    r = mt.basket_metrics(b).first()
    assert (r.candidate_count, r.positive_excess_rate, r.precision_top_20pct) == (3, pytest.approx(1 / 3), pytest.approx(1 / 3))


def test_constant_days_have_no_ic(spark):
    rows = [(1, 1.0, float(i)) for i in range(9)] + [(2, float(i), float(i)) for i in range(9)] + [(3, 1.0, 2.0)]
    got = mt.daily_ic(spark.createDataFrame(rows, "date int, f double, target_rank double"), ["f"], 5).collect()
    assert [(r.date, r.ic) for r in got] == [(2, pytest.approx(1.0))]


def test_greedy_redundancy():
    cor = {("b", "a"): 0.9, ("c", "a"): 0.5, ("c", "b"): 0.95, ("d", "a"): None, ("d", "c"): 0.85}
    got = greedy_selection(["a", "b", "c", "d", "e"], cor, 3, 0.85)
    assert got["a"] == (0.0, "", "") and got["b"] == (0.9, "a", "pairwise_correlation") and got["c"] == (0.5, "a", "")
    assert got["d"] == (0.85, "c", "") and got["e"][2] == "max_selected_features"
