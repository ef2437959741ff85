import random

import numpy as np
import pytest

from panelwright.llm.lyndon import suffix_arrays


def fibonacci(n):
    a, b = [1], [1, 2]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("seed", range(40))
def test_same_as_sorting(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(rng.choice([1, 1, 5, 40])):
        n, kinds = rng.choice([0, 1, 2, 7, 60, 300]), rng.choice([1, 2, 3, 26])
        t = [rng.randint(1, kinds) for _ in range(n)]
        if rng.random() < 0.3:
            t = (t[:5] * n)[:n]
        if rng.random() < 0.2:
            t = fibonacci(n)
        texts.append(t)
    symbols = np.array([s for t in texts for s in [*t, 0]], np.int64)
    sizes = np.array([len(t) + 1 for t in texts])
    want, base = [], 0
    for t in texts:
        full = [*t, 0]
        want += [base + i for i in sorted(range(len(full)), key=lambda i: full[i:])]
        base += len(full)
    assert suffix_arrays(symbols, sizes).tolist() == want


def test_nothing():
    assert len(suffix_arrays(np.empty(0, np.int64), np.empty(0, np.int64))) == 0
