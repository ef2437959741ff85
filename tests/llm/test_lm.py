import math
import random
import re
import zlib
from collections import Counter

import pytest

from panelwright.llm import lm

DOCS = "doc_id long, text string, score string, source string"


def words_of(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain(rows, order, prior):
    """Scores from whole counts, each token by the recursion of the smoothing."""
    counts = Counter()
    seqs = [("<s>", *words_of(t), "</s>") for _, t in rows]
    out = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows]
    for seq, held in zip(seqs, out, strict=True):
        for k in range(1, order + 1):
            for i in range(len(seq) - k + 1):
                counts[seq[i : i + k]] += not held
    uni = {g: c for g, c in counts.items() if len(g) == 1 and g != ("<s>",)}
    n, v = sum(uni.values()), sum(c > 0 for c in uni.values())

    def p(context, w):
        if not context:
            return (counts[w,] + 0.5) / (n + 0.5 * (v + 1))
        return (counts[(*context, w)] + prior * p(context[1:], w)) / (counts[context] + prior)

    found = []
    for (k, _), seq, held in zip(rows, seqs, out, strict=True):
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(seq[max(0, i - order + 1) : i], seq[i])) for i in range(1, len(seq)))
        found.append((k, held, len(seq) - 1, sum(counts[w,] > 0 for w in seq[1:]), n, base, score))
    return found


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_the_plain_recursion(spark, order):
    rng = random.Random(order)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "A", "a", "b c"]
    rows = [(i, rng.choice(["", " "]).join(["", *(rng.choice(vocabulary) + rng.choice([" ", "\n", "\t"]) for _ in range(rng.choice([0, 1, 5, 40])))])) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "a b"), (3, rows[3][1]), (1002, " ".join(rng.choice(vocabulary) for _ in range(3000))), (1003, "w1 unseen"), (1006, "w1 unseen")]
    df = spark.createDataFrame([(*r, "clash", "s") for r in rows], DOCS).repartition(3)
    found = sorted(map(tuple, lm.score_documents(df, order, 4.0, block_bytes=5000).collect()), key=str)
    want = sorted(plain(rows, order, 4.0), key=str)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)
    assert any(r[1] for r in found) and not all(r[1] for r in found)


def test_empty_table_and_untrained(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(df).count() == 0
    held = next(i for i in range(100) if lm.is_held_out(i))
    one = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()[0]
    assert (one.held_out, one.n_tokens, one.n_known, one.train_tokens, one.base_score, one.score) == (True, 3, 0, 0, 0.0, 0.0)
