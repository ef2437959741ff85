import random
import tracemalloc

from pyspark.sql import functions as F

from panelwright.llm import decontamination as d

SMALL = d.Settings(q=4, probe=24, stride=12, edits=2)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id long, begin string"


def least_edits(probe, text):
    """Of the probe anywhere in text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(probe, 1):
        above, row = row, [i]
        for j, b in enumerate(text, 1):
            row.append(min(above[j - 1] + (a != b), above[j] + 1, row[-1] + 1))
    return min(row)


def plain(docs, items, s):
    found = {}
    for item, text in items:
        text = d.normalised(text)
        if len(text) < s.q:
            for k, doc in docs:
                if text and b" " + text + b" " in b" " + d.normalised(doc) + b" ":
                    found[k, item] = 0
            continue
        begins = {*range(0, max(1, len(text) - s.probe + 1), s.stride), max(0, len(text) - s.probe)}
        for k, doc in docs:
            for b in begins:
                probe = text[b : b + s.probe]
                edits = least_edits(probe, d.normalised(doc))
                if edits <= s.budget(len(probe)):
                    found[k, item] = min(edits, found.get((k, item), 99))
    return found


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        text[i : i + 1] = rng.choice([[], [rng.choice("xyz")], [text[i], rng.choice("xyz")]])
    return "".join(text)


def test_no_match_is_lost_and_none_invented():
    rng = random.Random(7)
    letters = "abcde "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([3, 8, 20, 24, 30, 60])))) for i in range(25)] + [(90, ""), (91, "  ")]
    docs = [(0, ""), (1, "ab")]
    for i in range(2, 120):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.7:
            at = rng.randint(0, len(text))
            text = text[:at] + edited(rng, rng.choice(items[:25])[1], rng.randint(0, 4)) + text[at:]
        docs.append((i, text.upper() if rng.random() < 0.3 else text))
    raw = [(i, t.encode()) for i, t in items]
    matcher = d.Matcher(d.Probes.of(raw, SMALL))
    got = {(k, item): e for k, item, _, _, e in matcher.match([t.encode() for _, t in docs])}
    assert got == plain([(k, t.encode()) for k, t in docs], raw, SMALL)
    assert len(got) > 60


def test_q_gram_bound():
    s = d.Settings()
    assert s.least(96) == 96 - 10 + 1 - 10 * 5
    for q in (4, 10, 13):
        data = d.np.frombuffer(b"abcabcabcabcabcabcabcabc", d.np.uint8)
        grams = d._grams(data, q)
        assert len(grams) == len(data) - q + 1 and len(set(grams.tolist())) == 3


def test_query_shards_and_stage(spark, tmp_path):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "été"]
    text = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    items = [(i, text(30)) for i in range(6)] + [(None, "x y"), (77, None), (3, text(30))]
    docs = [(i, text(60)) for i in range(20)] + [(100 + i, f"{text(50)}\n{edited(rng, t.upper(), 2)} {text(5)}") for i, t in items[:6]]
    docs += [(200, None), (201, ""), (100, docs[20][1]), (None, items[1][1]), (202, text(40000) + " " + items[0][1])]
    df = spark.createDataFrame([(k, t, "en", "s", 0, 5, "x") for k, t in docs], DOCS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame(items, "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = d.op9_decontamination(spark, str(tmp_path)).collect()
    want = sorted([(100 + i, i) for i in range(6)] + [(100, 0), (None, 1), (202, 0)], key=str)
    assert sorted(((r.doc_id, r.item_id) for r in found), key=str) == want
    one = next(r for r in found if r.doc_id == 202)
    assert one.edits == 0 and d.normalised(docs[-1][1].encode())[one.begin : one.end] in d.normalised(items[0][1].encode())
    parts = d.matches(df, bench, chars=400).groupBy("doc_id", "item_id").agg(F.count("*").alias("n")).collect()
    assert sorted(((r.doc_id, r.item_id) for r in parts), key=str) == sorted(set(want), key=str)
    kept = d.drop_contaminated(spark, df, str(tmp_path))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(20), 200, 201]
    assert d.matches(df, bench.limit(0)).count() == 0 and d.drop_contaminated(spark, df.limit(0), str(tmp_path)).count() == 0


def test_excerpts_and_reworded_items_are_found(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    items = [(i, [rng.choice(words) for _ in range(40)]) for i in range(40)]
    docs = []
    for i, w in items:
        at = rng.randrange(40 - 13)
        docs.append((i, " ".join(w[at : at + 13])))
        new = list(w)
        for at in range(rng.randrange(10), 40, 10):  # one word in ten
            new[at] = rng.choice(words)
        docs.append((100 + i, " ".join(new)))
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(k, f"{text(30)} {t} {text(30)}") for k, t in docs] + [(200 + i, text(300)) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in d.matches(df, bench).collect()}
    long = {i for i, t in ((i, t.split()) for i, t in docs[: 2 * len(items) : 2]) if len(" ".join(t[30:43])) >= 55}
    assert len(long) > 35 and {(i, i) for i in long} <= found and {(100 + i, i) for i, _ in items} <= found
    assert all(k % 100 == i and k < 200 for k, i in found)


def test_the_bound_stays_positive():
    for s in (d.Settings(), d.CORPUS, SMALL):
        assert all(s.least(n) >= 1 for n in range(s.q, s.probe + 1))
    assert d.CORPUS.budget(d.CORPUS.probe) == d.CORPUS.edits


def test_memory_follows_neither_the_group_nor_a_long_text():
    """Of the same matches: hashes of all q-grams at once took some 50 bytes a byte of text."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(800)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    items = [(i, text(40)) for i in range(20)]
    matcher = d.Matcher(d.Probes.of(items, d.CORPUS))
    many = [text(300) for _ in range(1200)]
    many[700] += b" " + items[3][1]
    long = b" ".join(many[:700]) + b" " + items[5][1] + b" " + b" ".join(many[701:])
    for docs, want in ((many, [(700, 3)]), ([long], [(0, 5)])):
        size = sum(map(len, docs))
        tracemalloc.start()
        found = matcher.match(docs)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [h[:2] for h in found] == want and size > 2_000_000
        assert peak < 10 * size + 30_000_000


def test_counting_by_stretches_loses_nothing(monkeypatch):
    """Items of many probes, and stretches, pieces and buckets so small that all of them are split and shared."""
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    items = [(i, text(rng.choice([3, 8, 24, 30, 150, 400]))) for i in range(12)] + [(2, text(100))]
    docs = [(0, "")]
    for i in range(1, 40):
        item = rng.choice(items)[1]
        a = rng.randrange(max(1, len(item) - 60))
        docs.append((i, text(rng.randint(0, 200)) + edited(rng, item[a : a + 60], rng.randint(0, min(6, len(item) // 2))) + text(rng.randint(0, 200))))
    raw, found = [(i, t.encode()) for i, t in items], [t.encode() for _, t in docs]
    whole = d.Matcher(d.Probes.of(raw, SMALL)).match(found)
    assert {(k, item): e for k, item, _, _, e in whole} == plain([(k, t.encode()) for k, t in docs], raw, SMALL)
    assert len(whole) > 30
    for stretch, meetings, aligned, buckets in ((1, 300, 7, 2), (3, 2000, 100, 6), (7, 250_000, 4096, 12)):
        for name, value in (("_STRETCH", stretch), ("_MEETINGS", meetings), ("_ALIGNED", aligned), ("_BUCKETS", buckets)):
            monkeypatch.setattr(d, name, value)
        assert d.Matcher(d.Probes.of(raw, SMALL)).match(found) == whole


def test_common_syllables_and_passages_cost_little(monkeypatch):
    """Bytes sorted by the count and chosen by the alignment, a byte of text
    (3.3 and 137 where all q-grams were counted probe by probe and all bands traced)."""
    rng = random.Random(41)
    syllables = ["".join(rng.choice("etaoinshr") for _ in range(rng.choice([2, 3]))) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(40)) for i in range(200)]
    docs = [text(500) for _ in range(200)]
    for i in range(0, 200, 10):
        docs[i] += " " + edited(rng, items[i][1], i // 10 % 3)
    matcher = d.Matcher(d.Probes.of([(i, t.encode()) for i, t in items], d.CORPUS))
    done = {"unique": 0, "where": 0, "minimum": 0}

    def counted(name, of, which):
        def run(*args, **kwargs):
            done[name] += d.np.asarray(args[which]).nbytes
            return of(*args, **kwargs)

        monkeypatch.setattr(d.np, name, run)

    counted("unique", d.np.unique, 0)
    counted("where", d.np.where, 1)
    counted("minimum", d.np.minimum, 0)
    found = matcher.match([t.encode() for t in docs])
    monkeypatch.undo()
    assert {(i, i) for i in range(0, 200, 10)} <= {h[:2] for h in found}
    size = sum(map(len, docs))
    print("bytes a byte of text:", {k: round(v / size, 2) for k, v in done.items()})
    assert done["unique"] < size and done["where"] + done["minimum"] < 40 * size
