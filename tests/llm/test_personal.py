import hashlib
import random
import re
import time
from pathlib import Path

import pytest

from panelwright.llm import personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(number))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def plain(text):
    found = [(m.start(), "email", m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), "card", m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], personal.KINDS.index(s[1])))


def test_plain_identifiers_are_those_of_the_expressions():
    rng = random.Random(3)
    bits = ["a", "b1", "@", ".", "-", " ", "+", "1", "12", "255", "007", "(", ")", "%", "_", "x@y.z", "+1 682", "4111 1111 1111 1111", "é", "\n", "..", "日"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert personal.identifiers(text) == plain(text), text


NUMBERS = "zero one two three four five six seven eight nine".split()


def spelled(text):
    """Digits as words, the rest as it is."""
    return re.sub(" +", " ", "".join(f" {NUMBERS[int(c)]} " if c.isdigit() else c for c in text))


@pytest.mark.parametrize(
    ("kind", "told"),
    [
        ("email", "ann.lee [at] mail1 [dot] example [dot] com"), ("email", "ann(at)example(dot)com"), ("email", "ann@example dot com"), ("email", "ann {@} example.com"),
        ("email", "ann dot lee at mail1 dot example dot com"), ("email", "ANN AT EXAMPLE DOT COM"), ("email", "ann_at_example_dot_com"), ("email", "ann&#64;example&#46;com"),
        ("email", "аnn.33@mаil4.example.com"), ("email", "an​n@exa​mple.com"), ("email", "ａｎｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("email", "𝐚𝐧𝐧@example.com"),
        ("ip", "192[.]168[.]1[.]1"), ("ip", "10 dot 0 dot 0 dot 7"), ("ip", "one nine two dot one six eight dot zero dot one"), ("ip", "１９２.１６８.１.１"),
        ("card", "four one one one " + "one " * 11 + "one"), ("card", "４１１１ １１１１ １１１１ １１１１"),
        ("phone", "plus one six eight two five five five five four one three"), ("phone", "+1 (six eight two) five five five-5413"), ("phone", "plus 1 (682) 555-5413"),
        ("phone", "plus one (682) 555-5413"), ("phone", "+١ (٦٨٢) ٥٥٥-٥٤١٣"), ("phone", "más uno seis ocho dos cinco cinco cinco cinco cuatro uno tres"),
        ("phone", "plus eins sechs acht zwei fünf fünf fünf fünf vier eins drei"),
    ],
)
def test_disguised_identifiers_are_told_by_their_place_in_the_source(kind, told):
    for before, after in (("", ""), ("so write ", " today"), ("日本 ", "\n"), ("é: ", ", please")):
        text = before + told + after
        _, spans = personal.find_personal(text)
        assert (len(before), kind, len(before) + len(told)) in spans, spans


def test_random_numbers_disguised():
    rng = random.Random(5)
    for _ in range(300):
        number = f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        told = spelled(number).replace("+", "plus").strip()
        text = f"so {told} it is"
        found = personal.find_personal(text)[1]
        assert [k for _, k, _ in found] == ["phone"] and text[found[0][0] : found[0][2]] == told, told


def test_clean_texts_stay_clean():
    for text in (
        "we met at the shop; look at example.com. the dot and the comma", "one of two at the three", "one two three four five six seven eight nine",
        "the point is that two plus two is four", "version 1.2.3 of 2019-2020", "a dot at the end", "naïve café", "price @ 5.20 each", "[at] [dot] (.)",
    ):
        assert personal.find_personal(text) == ([], []), text


def test_base_stays_and_more_may_overlap_it():
    text = "jоhn@example.com and +1 682 555 5413 one"  # a Cyrillic letter: the plain rule begins after it
    base, spans = personal.find_personal(text)
    assert base == [(2, "email", 16), (21, "phone", 36)] and spans == [(0, "email", 16), *base]
    assert personal.masked(text) == "[email] and [phone] one"


def test_long_texts_take_linear_time():
    for part in ("a", "a.", "1", "1.", "one ", "( ", " ", "a@", "+1(", "one dot ", "at dot ", "[", "а", "​", "plus one "):
        started = time.time()
        personal.find_personal(part * (400000 // len(part)))
        assert time.time() - started < 20, part


def test_query(spark, tmp_path):
    rows = [(1, "a@b.c"), (1, "a@b.c"), (None, None), (2, ""), (3, "x 10 dot 0 dot 0 dot 7"), (4, "é +1 (682) 555-5413 " * 3000)]
    spark.createDataFrame([(k, t, k, t) for k, t in rows], "doc_id long, text string, spans long, n_ip string").write.parquet(str(tmp_path / "documents.parquet"))
    got = personal.op12_personal(spark, str(tmp_path)).collect()
    sha = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in spans).encode()).hexdigest()
    assert sorted((r["doc_id"] or 0, r["base_sha256"]) for r in got) == sorted((k or 0, sha(plain(t or ""))) for k, t in rows)
    assert {r["doc_id"]: r["spans"] for r in got}[3] == "ip:2:22"
    assert {r["doc_id"]: r["n_phone"] for r in got}[4] == 3000
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert personal.op12_personal(spark, str(tmp_path / "none")).count() == 0


def test_mask_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "to a@b.c", "x"), (2, None, "y")], "doc_id long, text string, `meta.x` string")
    assert [tuple(r) for r in personal.mask(docs).orderBy("doc_id").collect()] == [(1, "to [email]", "x"), (2, None, "y")]
    assert personal.mask(docs).columns == docs.columns


def test_whole_fixture(spark):
    folder = Path("/root/testdata/sf0.001")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(str(folder / "documents.parquet")).collect()}
    for r in personal.op12_personal(spark, str(folder)).collect():
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in plain(texts[r["doc_id"]])).encode()).hexdigest()
