import math
import random
import re

from panelwright.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, l_ string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_and_verdicts(spark):
    rng = random.Random(2)
    rows = [(i, None if i == 0 else "", "en", "s") for i in range(2)] + [(2, " \n\t", None, None)]
    for i in range(3, 120):
        parts = [rng.choice(["a", "bé", "c#", "|", "dd", "éé", "日本"]) + rng.choice(["", "", "x", "y"]) + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.choice([0, 1, 2, 3, 4, 60, 90, 300]))]
        rows.append((i, "".join(parts), rng.choice(["en", None]), rng.choice(["s", "t"])))
    line = " ".join(f"word{i}" for i in range(80))
    rows += [(200 + i, f"{line} {i}", "de", "u") for i in range(20)]
    rows += [(300, line.replace("word", "$$$#"), "de", "u"), (301, f"{line}\n" * 3, "de", "u"), (302, line, "de", "u"), (302, line, "de", "u")]
    rows.append((400, "spam " * 50000, "fr", "v"))
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    found = quality_rules.judge(df).collect()
    assert len(found) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] != 400}
    for r in found:
        if r.doc_id != 400:
            got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
            assert got == plain(texts[r.doc_id]), (r, texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in found}
    assert by[400].n_repeat_words == 50000 and not by[400].kept
    assert all(by[200 + i].kept for i in range(20)) and by[302].kept
    assert "symbol_share_high" in by[300].rules and not by[301].kept


def test_empty_table(spark):
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fences_follow_each_group(spark):
    """Verdicts against quantiles taken in a loop; repeated lines and windows fail at default settings."""
    rng = random.Random(9)
    rows = []
    for i in range(260):
        group = ("en", "calm") if i % 2 else ("en", "wild")
        lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(10)]
        if group[1] == "wild":
            lines += lines[: rng.randrange(4)]
        rows.append((i, "\n".join(lines), *group))
    lines = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(10)]
    rows += [(900, "\n".join(lines + lines[:4]), "en", "calm"), (901, "\n".join(lines + lines[:3]), "en", "wild")]
    found = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}

    def measures(text):
        n, chars, symbols, dup, repeat = plain(text)
        return {"word_length": chars / n, "symbol_share": symbols / n, "dup_line_share": dup / len(text.split("\n")), "repeat_share": repeat / n}

    for group in ("calm", "wild"):
        of = {r[0]: measures(r[1]) for r in rows if r[3] == group and not found[r[0]].base_failed}
        want = {k: [] for k in of}
        for name, side, q, reach, least in quality_rules.MEASURES:
            values = sorted(m[name] for m in of.values())
            at = lambda q, v=values: v[max(0, math.ceil(round(q * len(v), 6)) - 1)]
            wide = reach * (at(q) - at(1 - q))
            low, high = min(at(1 - q) - wide, at(0.5) - least), max(at(q) + wide, at(0.5) + least)
            for k, m in of.items():
                if side == "both" and m[name] < low:
                    want[k].append(f"{name}_low")
                if m[name] > high:
                    want[k].append(f"{name}_high")
        assert {k: found[k].rules for k in of} == want
    assert "dup_line_share_high" in found[900].rules and not found[900].kept and found[901].kept
