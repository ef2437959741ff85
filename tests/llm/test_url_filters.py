import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelwright.llm import url_filters

SCHEMA = "page_id long, url string, host string, segs string, label string"


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def general(path):
    out = []
    for s in path.split("/"):
        if not s:
            continue
        s = "{h}" if len(s) >= 16 and re.fullmatch(r"[0-9A-Fa-f-]+", s) and re.search(r"\d", s) else re.sub(r"[0-9]+", "{n}", s)
        if out and out[-1].rstrip("+") == s:
            out[-1] = s + "+"
        else:
            out.append(s)
    return tuple(out)


def shape(seg):
    if seg is None:
        return 0
    return 1 if seg == "{n}" else 2 if "{n}" in seg else 3 if seg.startswith("{h}") else 4 if re.fullmatch("[A-Za-z]+", seg) else 5


def chi_square(a, b):
    r = math.sqrt(sum(b) / sum(a))
    return sum((r * x - y / r) ** 2 / (x + y) for x, y in zip(a, b, strict=True) if x + y)


def brute_tree(pages, settings=url_filters.TreeSettings()):
    """(host, segs) -> (template, labelled, blocked, purity), by recursion over nested lists."""
    w = settings.weight
    hosts = defaultdict(Counter)
    for host, segs, label in pages:
        hosts[host][segs, label] += 1
    known = [x for x in pages if x[2] is not None]
    rate = sum(x[2] == "block" for x in known) / len(known) if known else 0.0
    out = {}

    def totals(rows):
        labelled = sum(n for (_, label), n in rows.items() if label is not None)
        return labelled, sum(n for (_, label), n in rows.items() if label == "block")

    def grow(host, rows, template, parent):
        level = len(template)
        labelled, blocked = totals(rows)
        purity = (blocked + w * parent) / (labelled + w)
        paths = {segs for segs, _ in rows}
        deeper = any(len(s) > level for s in paths)
        if len(paths) < settings.split or not deeper:
            for s in paths:
                out[host, s] = ("/".join(template + (("**",) if deeper else ())), labelled, blocked, purity)
            return
        ends = Counter({k: n for k, n in rows.items() if len(k[0]) == level})
        for s in {s for s, _ in ends}:
            l, b = totals(ends)
            out[host, s] = ("/".join(template), l, b, (b + w * purity) / (l + w))
        children = defaultdict(Counter)
        for (s, label), n in rows.items():
            if len(s) > level:
                children[s[level]][s, label] += n
        facts = {}
        for seg, kid in children.items():
            shapes = [0] * url_filters.SHAPES
            for (s, _), n in kid.items():
                shapes[shape(s[level + 1] if len(s) > level + 1 else None)] += n
            facts[seg] = (*totals(kid), shapes)
        visits = sum(sum(kid.values()) for kid in children.values())
        names = {}
        if len(children) >= settings.fan and visits <= settings.visits * len(children):
            names = dict.fromkeys(children, "*")
        else:
            bins = defaultdict(list)
            for seg, (l, b, _) in facts.items():
                if l:
                    bins[math.floor(b * url_filters.RATE_BINS / l + 0.5)].append(seg)
            groups, last = [], None
            for k in sorted(bins):
                l, b = (sum(facts[s][i] for s in bins[k]) for i in (0, 1))
                if last:
                    p = (b + last[1]) / (l + last[0])
                    apart = b / l - last[1] / last[0] > settings.z * math.sqrt(p * (1 - p) * (1 / l + 1 / last[0]))
                if not last or apart:
                    groups.append([])
                groups[-1] += bins[k]
                last = (l, b)
            titles, likes = [], []
            for i, g in enumerate(groups):
                titles.append(f"*{i}" if len(g) > 1 else f"{g[0]}~")
                likes.append([sum(facts[s][2][k] for s in g) for k in range(url_filters.SHAPES)])
                names.update(dict.fromkeys(g, titles[-1]))
            for seg, (l, _, shapes) in facts.items():
                if not l:
                    fits = [t for t, like in zip(titles, likes, strict=True) if chi_square(shapes, like) < url_filters.CHI_SQUARE]
                    names[seg] = fits[0] if len(fits) == 1 else seg
        merged = defaultdict(Counter)
        for seg, kid in children.items():
            merged[names[seg]].update(kid)
        for name, kid in merged.items():
            grow(host, kid, (*template, name), purity)

    for host, rows in hosts.items():
        grow(host, rows, (), rate)
    return out


def brute_judge(urls, settings=url_filters.TreeSettings()):
    rows = [plain(u) for u in urls]
    tree = brute_tree([(h, general(p), v) for h, p, _, v in rows], settings)
    known = {h for h, _, _, v in rows if v}
    out = Counter()
    for u, (host, path, rule, verdict) in zip(urls, rows, strict=True):
        template, labelled, _, purity = tree[host, general(path)]
        by = "rule" if verdict else "template" if labelled else "ancestor" if host in known else "default"
        out[u, host, path, rule, verdict or ("block" if purity >= settings.reject else "allow"), "/" + template, round(purity, 9), by] += 1
    return out


def judged(spark, urls):
    df = spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    found = url_filters.judge(df).collect()
    assert sorted(r.page_id for r in found) == list(range(len(urls)))
    return Counter((urls[r.page_id], r.host, r.path, r.rule, r.verdict, r.template, round(r.purity, 9), r.decided_by) for r in found)


def site(rng, host, n):
    """Pages of a host whose sections differ in labels and in shape."""
    out = []
    for _ in range(n):
        lang = rng.choice(["en", "de", "fr", "es", "it"])
        i = rng.randrange(1000)
        path = rng.choice([f"/{lang}/{i}", f"/{lang}/{i}.html", f"/{lang}/{i}/", f"/{lang}/", f"/tag/{rng.choice('abcdefghijklmno')}{i}x/", f"/user/{rng.randrange(16**20):020x}1/posts", "/a/a/a/a/b/", "/about"])
        out.append(f"http://{host}{path}" + rng.choice(["", "?q=1", "#x"]))
    return out


def test_tree_and_verdicts_against_brute_force_at_default_settings(spark):
    rng = random.Random(8)
    urls = [None, "", "no scheme", "http:/one", "://", "http://com", "a://b://c/en/"]
    for host in ("x.net", "y.net", "www.example.com", "b.example.com", "z.org", "small.net"):
        urls += site(rng, host, 4 if host == "small.net" else 120)
    urls += [f"http://deep.net/{'/'.join('abcdefgh'[: 3 + i % 6])}/{lang}/{i}" for i in range(40) for lang in ("p", "q")]
    urls += [f"http://deep.net/fr/{'x/' * (i % 7)}{i}" for i in range(40)] + ["http://x.net/fr/7"] * 30
    found, want = judged(spark, urls), brute_judge(urls)
    assert found == want
    verdicts = Counter((k[4], k[7]) for k in found.elements())
    assert verdicts["block", "template"] > 20 and verdicts["allow", "default"] > 20
    assert len({k[5] for k in found}) > 20


def test_unlabelled_branches_join_the_group_of_their_shape(spark):
    """Only sections that look like the blocked ones join them."""
    urls = [f"http://h.net/{s}/{i}" for s in ("es", "fr", "en") for i in range(20)]
    urls += [f"http://h.net/en/page{i}.html" for i in range(20)] + [f"http://h.net/de/{i}" for i in range(10)]
    urls += [f"http://h.net/{s}/page{i}.html" for s in ("es", "fr") for i in range(20)] + [f"http://h.net/de/page{i}.html" for i in range(10)]
    urls += [f"http://h.net/shop/{a}/{i}" for a in ("red", "blue") for i in range(50)]
    found = {k[0]: k for k in judged(spark, urls)}
    assert found["http://h.net/de/3"][5] == found["http://h.net/fr/3"][5] == "/*0/*0"
    assert found["http://h.net/de/3"][4] == "block"
    assert found["http://h.net/shop/red/3"][5].startswith("/shop/")


def test_purity_backs_off_to_the_parent(spark):
    pages = [("h", ("a", "b"), "block")] * 9 + [("h", ("a", "c", str(i)), None) for i in "wxyz"] + [("g", ("q",), "allow")] * 6
    df = spark.createDataFrame([(h, list(s), v) for h, s, v in pages], "host string, segs array<string>, label string")
    found = {(r.host, tuple(r.segs)): ("/".join(r.template), r.labelled, r.blocked, r.purity) for r in url_filters.template_tree(df).collect()}
    want = brute_tree(pages)
    assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in want.items()}
    assert all(found[k][3] == pytest.approx(want[k][3]) for k in want)
    assert found["h", ("a", "c", "w")][1] == 0 and found["h", ("a", "c", "w")][3] > 0.8


def test_parsing_and_rules(spark):
    rng = random.Random(4)
    hosts = ["com", "WWW.example.com", "a.www.example.com", "notexample.com", "example.com", "x.net", "netx", "", "é.net", "a.org"]
    urls = [None, "", "no scheme", "://", "http://x.net?/es/", "http://x.net#/es/"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/5', '/es/a?b#c', '/fr//x', '#/fr/', '/EN/'])}" for _ in range(200)]
    assert judged(spark, urls) == brute_judge(urls)


def test_segments(spark):
    paths = ["", "/", "//a//b/", "/12/x34y5", "/a/a/a/b/b/c/a", "/deadbeefdeadbeef1/x", "/deadbeefdeadbeef/x", "/7/8/9", "/" + "k/" * 3000 + "z" * 50_000]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [tuple(r[0]) for r in df.select(url_filters.segments(F.col("path"))).collect()] == [general(p) for p in paths]


def test_nulls_repeats_and_long_urls(spark):
    long = "http://x.net/fr/" + "ab/" * 2000 + "c" * 100_000
    rows = [(None, "http://com/"), (None, None), (5, "http://x.net/fr/1"), (5, "http://x.net/fr/1"), (6, long), (7, long.replace("fr", "en"))]
    found = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(found) == len(rows)
    assert {r.verdict for r in found if r.page_id == 5} == {"block"} and {r.verdict for r in found if r.host == "com"} == {"allow"}


def test_empty_table(spark):
    assert url_filters.judge(spark.createDataFrame([], SCHEMA)).count() == 0
