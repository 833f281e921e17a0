"""Connected components of a link table by union-find inside partitions and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import arrow_table, in_arrow, settle

LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
#: Links that a task unites at a time.
LINKS_AT_ONCE = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Union-find over links: (root, node) of every node that is not its component's smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        parent.setdefault(x, x)
        parent.setdefault(y, y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [n for n in parent if root(n) != n]
    return [root(n) for n in nodes], nodes


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as the star forest of each run of links: never more rows than came."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def out() -> pa.RecordBatch:
        roots, nodes = forest(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in ("a", "b")))
        return arrow_table({"a": roots, "b": nodes}, LINKS)

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LINKS_AT_ONCE:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over the links (a, b), for every node that is not smallest itself.

    First the links that lie in one partition are united; each round then joins every node to the
    smallest of its neighbours (large star, small star); nodes with many links are split by
    Spark's skew join, since a star's centre is found by an aggregate. Ends when only stars
    are left, or once the links are at most LINKS_AT_ONCE, which one task unites.
    """
    links = settle(in_arrow(links.select("a", "b").where("a <> b"), united, "a long, b long"), "links")
    while links.count() > LINKS_AT_ONCE:
        # Large star: every neighbour larger than the node moves to the smallest around it.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("low").alias("a"), "b").distinct()
        # Small star: every node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low, "b").select("low", "a", "b")
        moved = small.select(F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b")
        links = settle(moved.distinct(), "links")
        # Stars only: no node is both a centre and a ray, and every ray has one centre.
        if links.agg(F.count("*") == F.count_distinct("b")).first()[0] and links.select("a").join(links.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    # So few links that one task unites them all at once.
    return in_arrow(links.coalesce(1), united, "a long, b long").select(F.col("b").alias("node"), F.col("a").alias("component"))
