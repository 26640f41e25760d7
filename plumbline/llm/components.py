"""Connected components of a table of links, by alternating stars.

Every node points to the least neighbour; large stars hang larger neighbours on
the least one, small stars the rest. Before each round every task joins the links
that it reads, which leaves few rounds, and at most as many links. No node's links
are gathered in one row or task, so a hub may have any number of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.tables import record_batch, stash, trimmed

# Nodes that a task holds at a time while it joins its links.
HELD = 1 << 16


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that occurs in ``links`` (a, b); root is the least node reachable."""
    stars = stash(_joined(links.select("a", "b").where("a <> b")), "links")
    while True:
        # small files are read several at a time, so that a task sees more links than those that wrote them
        stars = stash(_joined(stars), "links")
        up = stars.select(F.col("a").alias("node"), F.col("b").alias("up"))
        up = up.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("up")))
        nodes = up.groupBy("node").agg(F.min("up").alias("root"), F.max("up").alias("most"))
        # a node with two roots, or a root with one above it, is not settled
        if not nodes.where("root < most").count():
            return nodes.select("node", "root")
        stars = stash(_small_star(_large_star(stars)), "links")


def _joined(links: DataFrame) -> DataFrame:
    """Links (node, least node) that connect the same nodes: those that a task meets are joined where they lie."""
    return links.mapInArrow(_join, links.schema)


@trimmed
def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def links(schema: pa.Schema) -> pa.RecordBatch:
        nodes = [x for x in list(parent) if root(x) != x]
        out = record_batch(schema, [nodes, [root(x) for x in nodes]])
        parent.clear()
        return out

    schema = None
    for batch in batches:
        schema = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
            if len(parent) >= HELD:
                yield links(schema)
    if parent:
        yield links(schema)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low"))
    least = least.select("a", F.least("a", "low").alias("low"))
    joined = both.join(least, "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    joined = links.join(least, "a")
    down = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return least.select("a", F.col("low").alias("b")).unionByName(down)
