"""Near-duplicates by the Jaccard similarity of word-shingle sets: candidates meet in min-hash bands, each is checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.components import components
from casebook.llm.hashing import mix
from casebook.llm.sketches import Shingler
from casebook.llm.storage import discard, stored

#: A pair of similarity s shares one of the bands with probability 1 - (1 - s**ROWS)**BANDS: 0.998 at 0.8.
BANDS, ROWS = 12, 4
#: Odd factors: each orders the hashed shingles in its own way.
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
#: Hubs of a bucket in the first round, and how many times as many in each later one.
HUBS, MORE = 1, 4
#: In buckets of more sets than this after the first round, sets are compared only if their rarest shingles meet.
CROWD = 32
#: Bounds that decide what is compared give way by this much, so that rounding drops no pair.
SLACK = 1e-3


def _sets(batch: pa.RecordBatch, shingler: Shingler, most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """The distinct shingles of the texts of a batch, some megabytes of text at a time."""
    group, size = [], 0
    for text in batch.column("text").to_pylist():
        group.append(text.encode() if text else b"")
        size += len(group[-1])
        if size >= most:
            yield [np.unique(hashes) for hashes in shingler.hashes(group)]
            group, size = [], 0
    if group:
        yield [np.unique(hashes) for hashes in shingler.hashes(group)]


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set; 0 for the empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(np.concatenate(sets)), dtype=np.uint64)])
    sizes = np.array([len(s) for s in sets])
    stops = np.cumsum(sizes)
    return np.where(sizes > 0, mix(sums[stops] - sums[stops - sizes] + sizes.astype(np.uint64)), np.uint64(0))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys of the bands of each set, one row per set; none of the sets is empty."""
    flat = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat(flat * factor, starts) for factor in _FACTORS], axis=1)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sets), 1))
    for row in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, row * BANDS : (row + 1) * BANDS])
    return keys


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """The columns of `docs` (without text), node (a hash of the shingle set), the set's size and the keys of its bands."""
    names = [c for c in docs.columns if c != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            nodes, sizes, bands = [], [], []
            for sets in _sets(batch, shingler):
                nodes.append(_nodes(sets).view(np.int64))
                sizes += [len(s) for s in sets]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full).view(np.int64).tolist() if full else [])
                bands += [next(keys) if len(s) else [] for s in sets]
            node = np.concatenate(nodes) if nodes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(node), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], [*names, "node", "size", "bands"])

    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names]
    return docs.mapInArrow(sign, ", ".join([*kinds, "node long", "size int", "bands array<long>"]))


def _shingled(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles (distinct) of column text."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            for sets in _sets(batch, shingler):
                rows = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(sets).view(np.int64)), rows], ["node", "shingles"])

    return docs.select("text").mapInArrow(shingle, "node long, shingles array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (hub, node) whose sets have at least that similarity."""
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("others")), "hub")
    shared = F.size(F.array_intersect("shingles", "others"))
    return both.where(shared >= least * (F.size("shingles") + F.size("others") - shared)).select("hub", "node")


def _rarest(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """node, at, shingle: of the sets of nodes the shingles (that two of them have) whose place from the rarest on is below
    1 - least of the set.

    All sets are ordered alike, so sets of that similarity have the first of their common shingles among these."""
    held = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle"))
    holders = held.groupBy("shingle").agg(F.count("*").alias("holders"))
    ordered = held.join(holders, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("all"))
    some = F.slice("all", 1, F.floor(F.size("all") * (1 - least) + SLACK).cast("int") + 1)
    placed = ordered.select("node", F.posexplode(some).alias("at", "one"))
    return placed.where("one.holders > 1").select("node", "at", F.col("one.shingle").alias("shingle"))


def _meeting(left: DataFrame, chosen: DataFrame, rarest: DataFrame, least: float) -> DataFrame:
    """key, hub, node: of the pairs of a bucket those that meet in a shingle from which on enough can be common.

    The first common shingle leaves no more common ones than the rest of either set."""
    ours = left.join(rarest, "node")
    theirs = chosen.join(rarest.select(F.col("node").alias("hub"), F.col("at").alias("hub_at"), "shingle"), "hub")
    rest = F.least(F.col("size") - F.col("at"), F.col("other") - F.col("hub_at"))
    enough = rest * (1 + least) >= (F.col("size") + F.col("other")) * least - SLACK
    return ours.join(theirs, ["key", "shingle"]).where((F.col("before") < F.col("row")) & _close(least) & enough).select("key", "hub", "node").distinct()


def _close(least: float) -> Column:
    """Sets of that similarity have sizes as close: other pairs go before their sets are fetched."""
    return F.least("size", "other") >= least * F.greatest("size", "other")


def _links(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """hub, node: checked links inside buckets (key, node, row, size of the set), from each node to nodes of smaller row.

    In each round the first nodes left in a bucket are its hubs. All others are compared with them, and hubs with one
    another; who is like an earlier hub leaves, so that of two nodes left at the end each was compared with the other.
    Where many are left after the first round, pairs whose rarest shingles show that they aren't alike are left out."""
    left, hubs, links, crowded, rarest = buckets, HUBS, None, None, None
    first = Window.partitionBy("key").orderBy("row")
    while not left.isEmpty():
        if links is not None and rarest is None:
            crowded = stored(left.groupBy("key").count().where(F.col("count") > CROWD).select("key"))
            rarest = stored(_rarest(left.join(crowded, "key", "left_semi").select("node").distinct(), sets, least))
        chosen = stored(
            left.withColumn("at", F.row_number().over(first)).where(F.col("at") <= hubs)
            .select("key", F.col("node").alias("hub"), F.col("row").alias("before"), F.col("size").alias("other"))
        )
        few = left if crowded is None else left.join(crowded, "key", "left_anti")
        met = few.join(chosen, "key").where((F.col("before") < F.col("row")) & _close(least)).select("key", "hub", "node")
        if crowded is not None:
            met = met.unionByName(_meeting(left.join(crowded, "key", "left_semi"), chosen, rarest, least))
        met = stored(met)
        found = stored(_alike(met.select("hub", "node").distinct(), sets, least))
        links = found if links is None else links.unionByName(found)
        gone = met.join(found, ["hub", "node"]).select("key", "node").unionByName(chosen.select("key", F.col("hub").alias("node")))
        before, left = left, stored(left.join(gone, ["key", "node"], "left_anti"))
        discard(chosen)
        discard(met)
        if before is not buckets:
            discard(before)
        hubs *= MORE
    if rarest is not None:
        discard(crowded)
        discard(rarest)
    return buckets.select(F.col("node").alias("hub"), "node").limit(0) if links is None else links


def clustered(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The columns of `docs` (doc_id, text and others; without text), node and root for every row.

    Rows of equal shingle sets, and of sets of at least that similarity that share a band, directly or through others,
    share root (a node). Of a bucket of many sets not all pairs are linked, but two least rows of different groups
    never have that similarity and a band in common. Texts without words are alike."""
    keyed = docs.withColumns({"__key": F.xxhash64("text", "doc_id"), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))})
    rows = stored(_signed(keyed, width))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("__id").alias("id"), F.col("__key").alias("key"))
    groups = stored(rows.groupBy("node").agg(F.min(order).alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    buckets = groups.select("node", "row", "size", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").count().where("count > 1").select("key")
    buckets = stored(buckets.join(shared, "key", "left_semi").select("key", "node", "row", "size"))
    wanted = buckets.select(F.col("row.key").alias("__key"), F.col("row.id").alias("__id")).distinct()
    sets = stored(_shingled(keyed.join(wanted, ["__key", "__id"], "left_semi").dropDuplicates(["__key", "__id"]), width))
    links = stored(_links(buckets, sets, least).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    discard(buckets)
    discard(sets)
    roots = stored(components(links))
    rooted = groups.select("node").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    return rows.drop("bands", "size", "__key", "__id").join(rooted.select("node", F.coalesce("root", "node").alias("root")), "node")
