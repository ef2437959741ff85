import hashlib
import random
import re
import zlib

import pytest

from panelwright.llm import conversations as cv

COLUMNS = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}
#: The sound sequences as a plain automaton: what may follow each initial.
NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Rows of one conversation in order: faults, and the least (cost, audit) of
    all edit sequences, by trying every edit at every row from every state."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = text.rstrip(SPACES)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)

    def inserted(ways):
        for _ in range(4):
            for q, (cost, audit, made) in list(ways.items()):
                for r in NEXT[q].replace("s", ""):
                    new = (cost + 5, audit + "I", [*made, f"{ROLE[r]}:"])
                    if r not in ways or new[:2] < ways[r][:2]:
                        ways[r] = new
        return ways

    ways = inserted({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for q, (cost, audit, made) in ways.items():
            tries = [(q, (cost + 2, audit + "D", made))]
            if fault in (None, "truncated"):
                more = 5 if fault else 0
                if role[:1] and role[:1] in NEXT[q]:
                    tries.append((role[0], (cost + more, audit + "K", [*made, f"{role}:{text}"])))
                tries += [(r, (cost + 1 + more, audit + "R", [*made, f"{ROLE[r]}:{text}"])) for r in NEXT[q] if r in "ua"]
            for to, new in tries:
                if to not in after or new[:2] < after[to][:2]:
                    after[to] = new
        ways = inserted(after)
    cost, audit, made = min((ways[q] for q in ("", "a") if q in ways), key=lambda x: x[:2])
    turns = [t for _, t, _, _ in rows if t is not None]
    initials = [role[:1] for _, _, role, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def plain(rows, after):
    def order(r):
        return (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest())

    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    groups = {r[0]: [] for r in rows}
    for r in after:
        groups[r[0]].append(r)
    return {conv: plain_repair(sorted(g, key=order)) if g else none for conv, g in groups.items()}


def got(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in frame.collect()}


def query(spark, tmp_path, rows, extra=()):
    spark.createDataFrame(rows, COLUMNS).selectExpr("*", *extra).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return cv.op11_conversations(spark, str(tmp_path))


def some(seed, conversations, longest):
    rng = random.Random(seed)
    texts = ["Fine.", "Fine.", "Good!", "So?", "cut off", "", " \t", "line\nbreak.", "été. ", "x" * 50 + "."]
    rows = []
    for conv in range(conversations):
        n = rng.randint(1, longest)
        for turn in range(n):
            role = ("user", "assistant")[turn % 2] if rng.random() < 0.7 else rng.choice(["system", "user", "assistant", "tool", "", None])
            text = rng.choice(texts) if rng.random() < 0.5 else f"Said {rng.randrange(10**6)}{rng.choice(['.', '!', ''])}"
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, None if rng.random() < 0.03 else text))
    return rows


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_same_as_trying_all_edits(spark, tmp_path, monkeypatch, bits):
    """Chunks of 2, 8 and 1,024 rows give what one piece gives."""
    monkeypatch.setattr(cv, "CHUNK_BITS", bits)
    monkeypatch.setattr(cv, "_BATCH", 4)
    rows = some(bits, 150, 14)
    rows += [(None, 0, "user", "A null id."), (None, 1, "assistant", "Is one conversation."), (900, None, None, None), (901, 5, "user", "Same.")]
    rows += [(901, 5, "user", "Same.")] * 40 + [(902, t, "user" if t % 2 == 0 else "assistant", f"Long one {t}.") for t in range(300)]
    rows += [(903, 1, "assistant", "y" * 200_000 + "."), (904, 1, "user", "Tie."), (904, 1, "assistant", "Tie."), (904, 1, "user", "Other tie.")]
    assert got(query(spark, tmp_path, rows, ["1 AS place", "2 AS n", "'z' AS `at.x`"])) == plain(rows, plain_damage(rows))


def test_empty_table_and_nothing_left(spark, tmp_path):
    assert got(query(spark, tmp_path, [])) == {}
    gone = [(c, t, "user", "Gone.") for c in range(200) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    assert set(got(query(spark, tmp_path, gone)).values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_rows_of_a_repair(spark):
    """The operator's own output: the repaired conversations with their texts."""
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Yes."), (1, 4, "user", " "),
        (2, 0, "user", "Why?"), (2, 1, "assistant", "Because."), (2, 2, "user", "And then?"), (2, 3, "user", "Then."),
    ]
    done = cv.repair(spark.createDataFrame(rows, COLUMNS))
    found = {}
    for r in sorted(done.rows.collect(), key=lambda r: (r["conv_id"], r["first"], r["number"])):
        found.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    # of one deletion each, deleting the earlier of the two rows is first in ASCII order
    assert found[1] == [("K", "system", "Be kind."), ("K", "user", "Hello."), ("K", "assistant", "Yes.")]
    # another role is cheaper than two deletions
    assert found[2] == [("K", "user", "Why?"), ("K", "assistant", "Because."), ("K", "user", "And then?"), ("R", "assistant", "Then.")]


def test_few_states():
    """The automaton stays small and is cached between scans."""
    machine = cv.Automaton(cv.Costs())
    rng = random.Random(1)
    for _ in range(300):
        machine.scan(machine.end, [(rng.randrange(9), 1) for _ in range(60)])
    assert len(machine.vectors) < 100
    size = len(machine.vectors)
    machine.scan(machine.end, [(rng.randrange(9), 1) for _ in range(5000)])
    assert len(machine.vectors) <= size + 5
