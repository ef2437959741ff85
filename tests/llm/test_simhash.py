import random
import re
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from panelwright.llm import simhash
from panelwright.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, fp string, id string"


def brute(rows, words=3, bits=2):
    def of(text):
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        if not found:
            return 0
        parts = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
        hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, f"{p:016x}", least.get(find(i))) for i, ((k, _), p) in enumerate(zip(rows, prints, strict=True)) if k is not None)


def test_components_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 30, 200]))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            if rng.random() < 0.5:
                copy[rng.randrange(len(copy))] = "Étrange"
            rows.append((len(rows), " \t".join(copy)))
    rows += [(900, None), (901, ""), (902, " \n "), (902, " \n "), (903, "One"), (904, "ONE two"), (905, "word " * 30000)]
    df = spark.createDataFrame([(k, t, "s", "clash", "clash") for k, t in rows], SCHEMA)
    found = simhash.near_duplicates(df).select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component").collect()
    assert sorted(map(tuple, found)) == brute(rows)


def test_links_find_every_pair(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = set(base)
    for x in base:
        for n in (1, 2, 3):
            values.add(x ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for bits in (1, 2, 3):
        want = {(a, b) for i, b in enumerate(signed) for a in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits}
        assert set(map(tuple, simhash.links(df, bits).collect())) == want
        assert set(map(tuple, simhash.links(df, bits, long_list=2).collect())) == want


def test_choices_of_positions_meet_every_pair():
    for bits in (1, 2, 3, 4):
        chosen = simhash.position_choices(bits)
        assert all(len(c) == 7 - bits for c in chosen)
        assert all(any(not set(c) & set(gap) for c in chosen) for gap in combinations(range(8), bits))
    assert len(simhash.position_choices(2)) <= 12


def test_the_count_filter_drops_pairs_that_meet(spark):
    """Three differing bytes: such pairs meet in a list, but share too few bytes."""
    rng = random.Random(6)
    values = {rng.getrandbits(63) for _ in range(20)}
    values |= {x ^ sum(1 << (8 * k + rng.randrange(7)) for k in rng.sample(range(8), n)) for x in list(values) for n in (1, 2, 3, 3, 3)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    masks = [sum(255 << (8 * k) for k in at) for at in simhash.position_choices(2)]
    posted = simhash._posted(df, masks)
    met = simhash._met(posted, 0, 64).distinct().count()
    counted = simhash._met(posted, 6, 64).distinct().count()
    assert met > counted > 0 and simhash.links(df).count() <= counted


def test_long_lists_are_cut(spark):
    """A cluster: all values of 14 bits around one fingerprint, in lists of 16,384."""
    df = spark.range(1 << 13).select((F.col("id") * 3).alias("fp"))
    near = {i * 3 for i in range(1 << 13)}
    want = sum(1 for x in near for m in (*(1 << i for i in range(15)), *((1 << i) | (1 << j) for i in range(15) for j in range(i))) if x ^ m in near and x < x ^ m)
    assert simhash.links(df).count() == want == simhash.links(df, long_list=100).count()


def test_long_chains_and_empty_input(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 100), (None, 4)]
    found = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + pairs
    df = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    one, many = (sorted(map(tuple, connected_components(df, n).collect())) for n in (10**6, 20))
    root = {x: x for p in pairs for x in p if x is not None and p[0] is not None}
    for _ in range(400):
        for a, b in pairs:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert one == many == sorted((x, r) for x, r in root.items() if any(x in p and p[0] not in (None, p[1]) for p in pairs))
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (7, "x y z")], "doc_id long, text string")
    assert sorted(simhash.near_duplicates(df).select("id", "component").collect(), key=str) == [(7, 7), (None, None), (None, None)]
    assert simhash.keep_one(spark, df, "").count() == 3


def test_stage_finds_all_similar_texts(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (30, 120, 400, 2000):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(n)]
            rows.append((len(rows), " ".join(base)))
            for edits in (1, n // 60, n // 40, n // 12):
                copy = list(base)
                for at in rng.sample(range(n), edits):
                    copy[at] = rng.choice(words)
                rows.append((len(rows), " ".join(copy)))
    passage = [rng.choice(words) for _ in range(90)]
    for i in range(80):  # a shared passage, and 8 to 60 words of their own
        own = [rng.choice(words) for _ in range(rng.choice([8, 20, 24, 40, 60]))]
        rows.append((len(rows), " ".join([*own, *passage] if i % 2 else [*passage, *own])))
    rows += [(len(rows), None), (len(rows) + 1, " "), (len(rows) + 2, "one two"), (len(rows) + 3, "one  Two")]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    lower = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(t[i : i + 5]) for i in range(max(1, len(t) - 4))} for t in lower]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {i for i in range(len(rows)) if find(i) == i}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(want) < len(rows) - 30
    assert {r.doc_id for r in simhash.keep_one(spark, df, "").collect()} == want
    bits = simhash.near_duplicates(df).where("id = component").count()
    assert len(want) < bits  # what 3 words and 2 bits leave


def prefixed(spark, rows):
    """Prefixes of (node, root, text) rows, with the roots."""
    df = spark.createDataFrame(rows, "node long, root long, text string").withColumn("text", F.col("text").cast("binary"))
    return simhash._prefixes(df.select("node", "root"), df.select("node", "text"), simhash.Copies()).join(df.select("node", "root"), "node")


def test_texts_that_share_a_passage_make_no_pairs(spark):
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, i, f"{passage} " + " ".join(f"u{i}x{j}" for j in range(30 + i % 5))) for i in range(200)]
    assert simhash._with_all(prefixed(spark, rows), simhash.Copies()).count() == 0


def test_prefixes_lose_no_similar_pair(spark):
    rows = [(i, i % 3, " ".join(f"w{(j + i) % 400}" if j != i else "new" for j in range(300))) for i in range(60)]
    sets = {n: simhash.shingle_set(t.encode()) for n, _, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and a % 3 != b % 3 and simhash.jaccard(sets[a], sets[b]) >= 0.8}
    posted = prefixed(spark, rows)
    found = set(map(tuple, simhash._with_all(posted, simhash.Copies()).collect()))
    assert want and want <= found and all(a % 3 != b % 3 for a, b in found)
    some = set(map(tuple, simhash._with_some(posted, simhash.Copies()).collect()))
    assert some <= found


def test_repeated_ids(spark):
    """Rows of one id are one document: they stay or go together."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (2, text), (2, "something else entirely"), (3, "something else entirely")]
    left = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, left.collect())) == [(1, text), (1, text)]


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_the_stage_indexes_simhash_fingerprints(spark):
    """A bit of the stage's fingerprint is 1 if over half of the shingles' hashes have it."""
    rng = random.Random(31)
    rows = [(n, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))) for n in (0, 3, 7, 8, 9, 10, 60, 5000)]
    copies = simhash.Copies()
    found = {r.id: list(r.places) for r in simhash._sketches(spark.createDataFrame(rows, "doc_id long, text string"), copies).collect()}
    full = (1 << 64) - 1
    for n, text in rows:
        grams = simhash.shingle_set(text.encode()).tolist()
        longs = 0 if len(grams) < 4 else 96 if len(grams) <= 5 else 48
        assert len(found[n]) == longs
        times, plus = simhash._odd(longs).tolist()
        for k in range(0, longs, 1 if n < 100 else 40):
            hashes = []
            for g in grams:
                x = (g ^ plus[k]) * times[k] & full
                x = (x ^ (x >> 32)) * plus[k] & full
                hashes.append(x ^ (x >> 29))
            assert found[n][k] == signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def test_lists_of_positional_bytes(spark):
    """Against brute force: pairs of different roots in the short lists, roots of the long ones, whichever batches they come in."""
    rng = random.Random(33)
    copies = simhash.Copies(longs=2, near=20, near_few=40, long_list=5, lead=2)
    prints = [[rng.getrandbits(64) for _ in range(4 if i % 3 else 2)] for i in range(30)]
    for base in prints[:12]:
        for _ in range(rng.choice([1, 2, 9])):
            prints.append([x ^ sum(1 << b for b in rng.sample(range(64), rng.choice([2, 6, 14]))) for x in base])
    prints.append([])
    nodes = [(rng.getrandbits(62) * rng.choice([1, -1]), rng.randrange(9), [signed(x) for x in p]) for p in prints]
    lists = {}
    for node, root, longs in nodes:
        for i, w in enumerate(longs):
            for j in range(4):
                lists.setdefault((i * 4 + j) << 16 | w >> 16 * j & 0xFFFF, []).append((node, root, longs))
    near = lambda x, y, most: sum(((x[k] ^ y[k]) & (1 << 64) - 1).bit_count() for k in (0, 1)) <= most
    pairs, open_roots, first = set(), [], set()
    for key, held in lists.items():
        one = min(held)
        first |= {(one[0], n) for n, _, p in held if key < 8 << 16 and n != one[0] and near(one[2], p, 20)}
        if len(held) > 5:
            open_roots.append({r for _, r, _ in held})
            continue
        met = {(min(a, b), max(a, b)) for (a, q, x), (b, r, y) in combinations(held, 2) if q != r and near(x, y, 20 if key < 8 << 16 else 40)}
        members = {n for pair in met for n in pair}
        if met and len(met) >= len(members):
            open_roots.append({r for n, r, _ in held if n in members})
        else:
            pairs |= met
    open_roots = {r for held in open_roots for r in held if len(held) > 1}
    df = spark.createDataFrame(nodes, "node long, root long, places array<long>")
    for rows in (1, 7, 10000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        try:
            found = simhash._met_apart(df, copies, len(nodes)).collect()
            starts = simhash._with_first(df, copies).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert pairs and {(r.a, r.b) for r in found if not r.long} == pairs
        assert open_roots and {x for r in found if r.long for x in (r.a, r.b)} == open_roots
        assert len(found) <= sum(map(len, lists.values()))
        assert first and set(map(tuple, starts)) == first


def test_the_stage_tallies_shared_bytes(spark):
    """Pairs that meet in a list go if they share too few bytes, or differ in too many bits."""
    rng = random.Random(35)
    base = [rng.getrandbits(64) for _ in range(48)]
    all_bytes = [x ^ 0x0101010101010101 for x in base]  # 384 bits, no byte
    half = [~x & (1 << 64) - 1 if i % 2 else x for i, x in enumerate(base)]  # 192 bytes, 1,536 bits
    near = [x ^ 0x0000000001010101 for x in base]
    df = spark.createDataFrame([(i, [signed(x) for x in p]) for i, p in enumerate((base, all_bytes, half, near))], "node long, places array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    assert [tuple(r) for r in simhash._tallied(pairs, df, simhash.Copies()).collect()] == [(0, 3)]


def test_long_lists_lose_no_similar_text(spark):
    """Groups of copies and near misses, whether their lists count as long or not; four and five shingles too."""
    rng = random.Random(37)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for n in (8, 9, 40, 300):
        for _ in range(3):
            base = [rng.choice(words) for _ in range(n)]
            for k in range(12):
                copy = base[: n - (k % 2)]
                if k > 5 and n > 9:
                    copy[rng.randrange(len(copy))] = "other"
                rows.append((len(rows), " ".join(copy)))
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for long_list in (2, 16):
        found = simhash.near_copies(df, simhash.Copies(long_list=long_list)).collect()
        assert sorted(map(tuple, found)) == list(enumerate(root))
