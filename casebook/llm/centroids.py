"""Vectors clustered around centroids, their dot products kept exact and updated where a centroid changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm import integers as it
from casebook.llm.storage import stored

#: A row's integers and its dot products with all centroids; rows of integers too large for longs hold both as text.
_STATE = "ints array<long>, dots array<long>, wide string"


def _packed(rows: np.ndarray, dots: np.ndarray) -> list[pa.Array]:
    n = len(rows)
    if rows.dtype == object or dots.dtype == object:
        text = ["|".join(",".join(map(str, v)) for v in pair) for pair in zip(rows.tolist(), dots.tolist(), strict=True)]
        return [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64())), pa.array(text, pa.string())]

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * values.shape[1], pa.int32()), pa.array(values.ravel(), pa.int64()))

    return [lists(rows), lists(dots), pa.nulls(n, pa.string())]


def _unpacked(batch: pa.RecordBatch, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    ints, dots, wide = (batch.column(name) for name in ("ints", "dots", "wide"))
    if wide.null_count == len(wide):
        return tuple(c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), w) for c, w in ((ints, width), (dots, n)))
    both = [[i, d] if text is None else [[int(v) for v in part.split(",")] for part in text.split("|")] for i, d, text in zip(ints.to_pylist(), dots.to_pylist(), wide.to_pylist(), strict=True)]
    return tuple(np.array([pair[k] for pair in both], object).reshape(len(both), w) for k, w in ((0, width), (1, n)))


def _apart(dots: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances less the row's own square, which changes no order."""
    return it.squares(centroids)[None, :] - 2 * dots


def update(rows: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """Dot products after `change` was added to the centroids: only its non-zero components are multiplied."""
    dots = dots.copy() if change.dtype != object else dots.astype(object)
    for at, moved in enumerate(change):
        places = np.flatnonzero(moved)
        if len(places):
            more = it.product(rows[:, places], moved[None, places])[:, 0]
            if more.dtype == object and dots.dtype != object:
                dots = dots.astype(object)
            dots[:, at] += more
    return dots


def cluster(
    vectors: DataFrame, column: str = "embedding", width: int = 64, count: int = 16, rounds: int = 3, factor: int = 64, seed: str = "1"
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance of every usable row; the final centroids).

    Usable vectors have `width` components, none null or not finite; a component x becomes floor(factor * x). Centroids
    start as the `count` rows of smallest sha256 of "seed:vec_id" (repeated ids by their vectors; rows without an id
    start none). Ties go to the smaller number. Without any centroid, cluster and distance are null; so is a distance
    beyond a long. Each round reads and writes the table of dot products once and adds up members' sums by Spark; the
    driver gets one row per centroid and component."""
    kept = vectors.where(it.finite(column) & (F.size(column) == width)).select("vec_id", column)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = kept.where("vec_id is not null").orderBy(key, column).limit(count).collect()
    centroids = it.floors(np.array([row[column] for row in chosen], np.float64).reshape(len(chosen), width), factor).tolist()
    n = len(centroids)
    if not n:
        return kept.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    table = it.rows_of(centroids)

    def begun(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = it.floors(it.matrix(batch.column(1), width), factor)
        return pa.RecordBatch.from_arrays([batch.column(0), *_packed(rows, it.product(rows, table))], ["vec_id", "ints", "dots", "wide"])

    schema = f"vec_id {kind}, {_STATE}"
    state = stored(kept.mapInArrow(it.batched(begun), schema))
    change = np.zeros_like(table)
    for at in range(rounds):

        def members(batches: Iterator[pa.RecordBatch], now: np.ndarray = table) -> Iterator[pa.RecordBatch]:
            sums = it.Sums(n, width)
            for batch in batches:
                rows, dots = _unpacked(batch, width, n)
                sums.add(_apart(dots, now).argmin(axis=1), rows)
            yield sums.rows()

        fresh = it.means(state.drop("vec_id").mapInArrow(members, it.SUMS), n, width)
        before, table = table, it.rows_of([fresh.get(c, old) for c, old in enumerate(centroids)])
        centroids, change = table.tolist(), table - before
        if at < rounds - 1 and change.any():

            def moved(batch: pa.RecordBatch, change: np.ndarray = change) -> pa.RecordBatch:
                rows, dots = _unpacked(batch, width, n)
                return pa.RecordBatch.from_arrays([batch.column(0), *_packed(rows, update(rows, dots, change))], batch.schema.names)

            state = stored(state.mapInArrow(it.batched(moved), schema))

    def settled(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, dots = _unpacked(batch, width, n)
        apart = _apart(update(rows, dots, change) if change.any() else dots, table)
        nearest = apart.argmin(axis=1)
        distance = it.squares(rows) + apart[np.arange(len(rows)), nearest]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(nearest, pa.int32()), it.longs(distance)], ["vec_id", "cluster", "distance"])

    return state.mapInArrow(it.batched(settled), f"vec_id {kind}, cluster int, distance long"), centroids


def cluster_report(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of `vectors`.

    Inertia is the distance summed over the cluster and over all rows; null if it or one of them is beyond a long. Rows
    that `cluster` can't use are dropped, repeated rows give repeated rows, other columns are not read."""
    found, centroids = cluster(vectors, column)
    found = stored(found)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    sums = found.groupBy("cluster").agg(it.total("distance").alias("cluster_inertia"))
    whole = found.agg(it.total("distance")).collect()[0][0] if centroids else None
    named = found.sparkSession.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    facts = F.broadcast(sums.join(named, "cluster"))
    return found.join(facts, "cluster", "left").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole).cast("long").alias("inertia"), "centroid_sha256"
    )
