"""Connected components of a links table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.storage import discard, stored

#: Links that a task contracts at once.
PART = 1 << 18


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that is not the least of its component among them, and that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while (root[x] != root[y]).any():
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while (root != root[root]).any():
            root = root[root]
    leaves = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[leaves], nodes[root[leaves]]


def _contracted(links: DataFrame) -> DataFrame:
    """Links that connect the same nodes: those a task reads become stars, a part at a time, without a shuffle."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def part() -> pa.RecordBatch:
            ends = stars(*(np.concatenate([batch.column(i).to_numpy() for batch in held]) for i in range(2)))
            return pa.RecordBatch.from_arrays([*map(pa.array, ends)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PART:
                yield part()
                held, size = [], 0
        if size:
            yield part()

    return links.select("a", "b").mapInArrow(contract, "a long, b long")


def _least(links: DataFrame, hub: str, leaf: str) -> DataFrame:
    """Every hub and its least neighbour or itself; partial minima go before the shuffle."""
    return links.groupBy(hub).agg(F.least(F.min(leaf), F.first(hub)).alias("least"))


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(_least(both, "a", "b"), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Links point from the larger node a to the smaller b."""
    least = _least(links, "a", "b")
    leaves = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b")
    return leaves.union(least.select("a", F.col("least").alias("b"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether links are stars: no node points to two others, or to one and is pointed to."""
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("up"), F.lit(False).alias("hub")).union(
        links.select("b", F.lit(None).cast("long"), F.lit(True))
    )
    met = ends.groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.max("hub").alias("hub"))
    return met.where("least <> most OR hub AND least IS NOT NULL").count() == 0


def components(links: DataFrame) -> DataFrame:
    """node, root: each node that has a link, and the least node of its component, from links (a, b) of long nodes.

    Self-links are ignored, repeated ones count once; no links give no rows. What a task reads is contracted and written
    before it is shuffled, so a task that runs again changes nothing. Each round halves the depth of the trees and
    replaces the table of the one before. It ends when only stars are left: while others are, a round lowers the sum of
    all links' ends."""
    turned = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    current = stored(_contracted(turned))
    while not _settled(current):
        merged = stored(_small(_large(current)))
        discard(current)
        current = stored(_contracted(merged))
        discard(merged)
    rooted = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return rooted.union(rooted.select(F.col("root").alias("node"), "root")).distinct()
