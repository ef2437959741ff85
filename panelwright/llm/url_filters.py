"""URL filters over a tree of path templates, with DataFrame functions only.

Every host has a tree of its paths, grown level by level to its full depth:

* segments are generalised first: digits, long identifiers and repetitions of
  one segment become classes of their own;
* a node whose children hardly repeat gets one wildcard child;
* labelled children whose rates of blocked pages can't be told apart (a
  two-proportion test between neighbours in the order of the rates) are merged;
  into groups (`*0`, `*1`, ...; `x~` if x is the only labelled one);
* an unlabelled child joins the one group whose subtree has the same shape (a
  chi-square test on the kinds of segments that follow); if it fits none, or
  several, it stays alone;
* a node with few different paths isn't split any more: its paths share `**`.

Each node's purity (its rate of blocked pages) is smoothed towards its parent's,
and the root's towards the rate of all labelled pages, so that templates without
labels have their ancestors' evidence. Templates of high purity are rejected.

The tree is grown on counts by (host, path). Counts are summed before each
shuffle; joins to a node's facts are salted by the child, so that a host with a
third of all pages is dealt to many tasks. There is a round of jobs for each
level, on the paths that aren't settled yet.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import stage, table

_A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: (verdict, host, path): a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Kinds of a following segment: none, a number, one with numbers, an identifier, a word, else.
SHAPES = 6
#: 99 % point of chi-square with SHAPES - 1 degrees of freedom.
CHI_SQUARE = 15.086
#: Children with equal rates to 1 / RATE_BINS are alike; their bins are then tested.
RATE_BINS = 20
#: Tasks over which the children of one node can be dealt in a join.
SALTS = 16


@dataclass(frozen=True)
class TreeSettings:
    """A node with at least `fan` children, of `visits` pages each at most on
    average, is variable. Neighbouring groups of labelled children merge if
    their rates differ by less than `z` standard errors. A node with fewer than
    `split` different paths isn't split. A node's purity counts `weight` pages
    of its parent's; a template is rejected if it is at least `reject`."""

    fan: int = 8
    visits: float = 2.0
    z: float = 2.576
    split: int = 4
    weight: float = 5.0
    reject: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null urls and those without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, *_A_Z), F.regexp_extract(tail, "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Of equally
    long ones, the last listed."""
    rule = verdict = F.lit(None).cast("string")
    for what, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """All segments that aren't empty, generalised: identifiers of 16 or more
    hexadecimal digits and dashes are `{h}`, digits `{n}`, and repetitions of a
    segment in a row are one `segment+`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(parts, lambda s: F.when(F.rlike(s, F.lit("^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*$")) & (F.length(s) >= 16), "{h}").otherwise(F.regexp_replace(s, "[0-9]+", "{n}")))
    # each with its neighbours: what equals the one before goes, what equals the one after gets a plus
    before = F.concat(F.array(F.lit("")), general)
    after = F.concat(F.slice(general, F.lit(2), F.size(general)), F.array(F.lit("")))
    marked = F.zip_with(
        F.zip_with(general, F.slice(before, F.lit(1), F.size(general)), lambda s, b: F.when(s != b, s)),
        F.zip_with(general, F.when(F.size(general) > 0, after), lambda s, a: s == a),
        lambda s, more: F.when(more, F.concat(s, F.lit("+"))).otherwise(s),
    )
    return F.coalesce(F.filter(marked, lambda s: s.isNotNull()), F.expr("cast(array() AS array<string>)"))


def _shape(seg: Column) -> Column:
    """The kind of a segment, 0 to SHAPES - 1; null: none follows."""
    return (
        F.when(seg.isNull(), 0)
        .when(seg == "{n}", 1)
        .when(F.contains(seg, F.lit("{n}")), 2)
        .when(F.startswith(seg, F.lit("{h}")), 3)
        .when(F.rlike(seg, F.lit("^[A-Za-z]+$")), 4)
        .otherwise(5)
    )


def _chi_square(a: Column, b: Column) -> Column:
    """Two-sample chi-square of two arrays of counts (neither is all zero)."""
    zero = F.lit(0.0)
    total = lambda x: F.aggregate(x, zero, lambda s, v: s + v.cast("double"))
    ratio = F.sqrt(total(b) / total(a))
    part = lambda x, y: F.when(x + y > 0, F.pow(ratio * x - y / ratio, 2) / (x + y)).otherwise(zero)
    return F.aggregate(F.zip_with(a, b, part), zero, lambda s, v: s + v)


_NODE = ["host", "template"]


def _salted(many: DataFrame, few: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """many joined with few (at most a few rows for each key), which is repeated
    for each of SALTS parts of many's rows of that key, by a hash of `by`."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "salt"], how).drop("salt")


def _named(children: DataFrame, settings: TreeSettings) -> DataFrame:
    """host, template, seg and name of every child: its segment, or the group
    with which it is merged."""
    nodes = children.groupBy(*_NODE).agg(F.count("*").alias("fan"), F.sum("n").alias("visits"))
    known = _salted(children, nodes, _NODE, ["seg"])
    known = known.withColumn("variable", (F.col("fan") >= settings.fan) & (F.col("visits") <= settings.visits * F.col("fan")))
    known = known.withColumn("bin", F.when(~F.col("variable"), F.round(F.try_divide(F.col("blocked") * F.lit(RATE_BINS), F.col("labelled").cast("double")))).cast("int"))
    shapes = [F.sum(F.get("shapes", F.lit(k))).alias(f"shape{k}") for k in range(SHAPES)]
    bins = known.where("bin IS NOT NULL").groupBy(*_NODE, "bin").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("members"), F.min("seg").alias("least"), *shapes)
    # at most RATE_BINS + 1 rows for each node: neighbours by rate are tested against each other
    by_rate = W.partitionBy(*_NODE).orderBy("bin")
    l0, b0 = F.lag("l").over(by_rate), F.lag("b").over(by_rate)
    pooled = (F.col("b") + b0) / (F.col("l") + l0)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / l0))
    apart = l0.isNotNull() & (F.col("b") / F.col("l") - b0 / l0 > settings.z * error)
    bins = bins.withColumn("apart", apart.cast("int")).withColumn("group", F.sum("apart").over(by_rate))
    total = [F.sum(f"shape{k}").alias(f"shape{k}") for k in range(SHAPES)]
    groups = bins.groupBy(*_NODE, "group").agg(F.sum("members").alias("members"), F.min("least").alias("least"), F.collect_list("bin").alias("bins"), *total)
    title = F.when(F.col("members") > 1, F.concat(F.lit("*"), F.col("group").cast("string"))).otherwise(F.concat("least", F.lit("~")))
    like = F.array(*(f"shape{k}" for k in range(SHAPES)))
    groups = groups.groupBy(*_NODE).agg(F.collect_list(F.struct("bins", title.alias("title"), like.alias("like"))).alias("groups"))
    met = _salted(known, groups, _NODE, ["seg"], "left")
    # the groups of a child: that of its bin, or, without labels, those it can't be told from
    of_bin = F.filter("groups", lambda g: F.array_contains(g["bins"], F.col("bin")))
    alike = F.filter("groups", lambda g: _chi_square(F.col("shapes"), g["like"]) < CHI_SQUARE)
    fits = F.when(F.col("bin").isNotNull(), of_bin).otherwise(alike)
    chosen = F.when(F.size(fits) == 1, F.get(fits, F.lit(0))["title"])
    return met.select(*_NODE, "seg", F.when(F.col("variable"), "*").otherwise(F.coalesce(chosen, F.col("seg"))).alias("name"))


def template_tree(pages: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """pages: host, segs (array), label (`block`, `allow` or null). Returns for
    every (host, segs) its template (array), the template's labelled and
    blocked pages, and its smoothed purity. No pages: no rows."""
    w = settings.weight
    paths = pages.groupBy("host", "segs").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.count(F.when(F.col("label") == "block", 1)).alias("blocked")
    )
    tree = stage(paths.withColumn("template", F.expr("cast(array() AS array<string>)")), "tree")
    rate = tree.agg(F.try_divide(F.sum("blocked").cast("double"), F.sum("labelled").cast("double"))).first()[0] or 0.0
    active, settled, level = tree.withColumn("parent", F.lit(rate)), [], 0
    kept = ["host", "segs", "n", "labelled", "blocked", "template", "parent"]
    while True:
        nodes = active.groupBy(*_NODE).agg(
            F.count("*").alias("paths"),
            F.max(F.size("segs")).alias("deepest"),
            F.sum("labelled").alias("node_labelled"),
            F.sum("blocked").alias("node_blocked"),
            F.first("parent").alias("above"),
        )
        purity = (F.col("node_blocked") + w * F.col("above")) / (F.col("node_labelled") + w)
        nodes = nodes.select(*_NODE, "paths", "deepest", "node_labelled", "node_blocked", purity.alias("purity"))
        at = _salted(active, nodes, _NODE, ["segs"]).withColumn("seg", F.get("segs", F.lit(level)))
        leaf = (F.col("paths") < settings.split) | (F.col("deepest") <= level)
        at = stage(at.withColumn("state", F.when(leaf, "leaf").when(F.col("seg").isNull(), "end").otherwise("open")), "tree")
        tail = F.when(F.col("deepest") > level, F.concat("template", F.array(F.lit("**")))).otherwise(F.col("template"))
        settled.append(at.where("state = 'leaf'").select("host", "segs", tail.alias("template"), F.col("node_labelled").alias("labelled"), F.col("node_blocked").alias("blocked"), "purity"))
        # paths that end at a node which is split further are a template of their own
        ends = at.where("state = 'end'")
        own = (F.col("blocked") + w * F.col("above")) / (F.col("labelled") + w)
        sums = ends.groupBy(*_NODE).agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.first("purity").alias("above"))
        settled.append(_salted(ends.select("host", "segs", "template"), sums.select(*_NODE, "labelled", "blocked", own.alias("purity")), _NODE, ["segs"]).select("host", "segs", "template", "labelled", "blocked", "purity"))
        open_rows = at.where("state = 'open'")
        if open_rows.isEmpty():
            break
        shape = _shape(F.get("segs", F.lit(level + 1)))
        counts = F.array(*(F.sum(F.when(shape == k, F.col("n")).otherwise(0)) for k in range(SHAPES)))
        children = open_rows.groupBy(*_NODE, "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), counts.alias("shapes"))
        named = _named(stage(children, "children"), settings)
        grown = _salted(open_rows, named, [*_NODE, "seg"], ["segs"])
        grown = grown.select("host", "segs", "n", "labelled", "blocked", F.concat("template", F.array("name")).alias("template"), F.col("purity").alias("parent"))
        active, level = stage(grown.select(*kept), "tree"), level + 1
    return reduce(DataFrame.unionByName, settled)


def judge(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity and decided_by of
    every row of pages (page_id, url). The pages that a rule fits are the
    labelled ones; the others are blocked if their template is rejected.

    decided_by is `rule`, `template` (it holds labelled pages), `ancestor` (a
    node above it does) or `default` (the host has no labelled page, so that the
    rate of all pages decides). Null urls and those without a host share the
    tree of host ''; null ids and repeated rows are pages of their own, and count
    as often as they occur; urls of any length are read whole. Equal rates and
    equal shapes give equal templates, whatever the order of rows."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("label"), segments(F.col("path")).alias("segs"))
    tree = template_tree(rows.select("host", "segs", "label"), settings)
    labelled_hosts = rows.where("label IS NOT NULL").select("host").distinct().withColumn("host_known", F.lit(True))
    tree = tree.join(labelled_hosts, "host", "left")
    by = F.when(F.col("label").isNotNull(), "rule").when(F.col("labelled") > 0, "template").when(F.col("host_known"), "ancestor").otherwise("default")
    return rows.join(tree, ["host", "segs"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("label", F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "purity",
        by.alias("decided_by"),
    )


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
