"""Connected components: tasks contract their links, stars join the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import delete_path, stage

#: Links that one task contracts at once.
TASK_LINKS = 1_000_000


def local_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node of the links that isn't a root itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        # hang both ends' roots under the smaller one, then halve paths
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    held = root != np.arange(len(nodes))
    return nodes[held], nodes[root[held]]


def _contracted(links: DataFrame, tasks: int) -> DataFrame:
    """links (u, v) with those of each task replaced by stars, u > v."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        held += [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
        found = local_roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])

    return links.coalesce(tasks).mapInArrow(of, "u long, v long")


def _star(pairs: DataFrame) -> DataFrame:
    """Links every partner v of u to the least of u and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) of every node of links (a, b); root is the component's least
    node. Nodes are longs; loops and null ends are ignored; no links: empty.

    First every task contracts up to about task_links links to stars by itself.
    Where there is more than one task, rounds follow in which neighbours are
    hung under smaller nodes (Kiveris et al., 2014), so their number grows with
    the logarithm of a component's diameter. A node of very many links is
    aggregated before the shuffle and its rows are joined, which adaptive
    execution can split. Links stay on executors.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    now = stage(
        links.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    tasks = max(1, -(-now.count() // task_links))
    now = stage(_contracted(now, tasks), "links")
    before = None
    while tasks > 1:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = _star(large)
        small = (
            starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(starred.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        after = stage(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for path in now.inputFiles()[:1]:
            delete_path(now.sparkSession, path.rsplit("/", 1)[0])
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
