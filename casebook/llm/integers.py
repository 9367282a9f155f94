"""Exact integer vectors: scaling, limb-split matrix products, sums of groups."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a limb in sums of components; a batch's product with group marks stays below 2^53.
SUM_BITS = 32
#: Totals of at most so many groups are broadcast.
LISTED = 100_000


def finite(vector: str) -> Column:
    """Vectors that are not null and hold no null and no component that is not finite (an empty one holds none)."""
    v, top = F.col(vector), F.lit(float("inf"))
    within = (F.size(v) == 0) | ((F.array_max(v) < top) & (F.array_min(v) > -top))
    return v.isNotNull() & (F.size(F.array_compact(v)) == F.size(v)) & within


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as rows of float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def floors(values: np.ndarray, factor: int) -> np.ndarray:
    """floor(factor * value) for a power of two, in int64, or in Python integers if one does not fit."""
    if not values.size or np.abs(values).max() < 2.0**61 / factor:
        return np.floor(values * factor).astype(np.int64)
    exact = [math.floor(v * factor) if abs(v) < 2.0**52 else int(v) * factor for v in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 matrices that add up to int64 `values`, each times one more power of 2^bits; only the last has signs."""
    found = []
    while values.size and max(int(values.max()), -int(values.min())) >= 1 << bits:
        found.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits
    return [*found, values.astype(np.float64)]


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def product(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact dot product of every row with every entry.

    Limbs are so short that each float64 BLAS product stays below 2^53; they are put together in int64. Where squared
    distances would not fit 62 bits, Python integers take over."""
    width = rows.shape[1]
    if object in (rows.dtype, entries.dtype) or width * max(_largest(rows), _largest(entries)) ** 2 >= 1 << 60:
        return rows.astype(object) @ entries.astype(object).T
    bits = (53 - width.bit_length()) // 2
    right = limbs(entries, bits)
    total = np.zeros((len(rows), len(entries)), np.int64)
    for i, a in enumerate(limbs(rows, bits)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


def squares(rows: np.ndarray) -> np.ndarray:
    """Exact squared length of every row."""
    if rows.dtype == object or rows.shape[1] * _largest(rows) ** 2 >= 1 << 62:
        rows = rows.astype(object)
        return (rows * rows).sum(axis=1) if rows.shape[1] else np.zeros(len(rows), object)
    return (rows * rows).sum(axis=1)


def longs(values: np.ndarray) -> pa.Array:
    """As 64-bit integers; those beyond are null."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([v if -(1 << 63) <= v < 1 << 63 else None for v in values.tolist()], pa.int64())


class Sums:
    """Component sums and sizes of groups, exact over any number of batches of one task."""

    def __init__(self, groups: int, width: int):
        self.groups, self.width = groups, width
        self.sizes = np.zeros(groups, np.int64)
        self.limbs: dict[int, np.ndarray] = {}

    def add(self, group: np.ndarray, rows: np.ndarray) -> None:
        marks = (np.arange(self.groups)[:, None] == group[None, :]).astype(np.float64)
        self.sizes += marks.sum(axis=1).astype(np.int64)
        if rows.dtype == object:
            parts, mask = [], (1 << SUM_BITS) - 1
            while _largest(rows) >= 1 << SUM_BITS:
                parts.append((rows & mask).astype(np.float64))
                rows = rows >> SUM_BITS
            parts.append(rows.astype(np.float64))
        else:
            parts = limbs(rows, SUM_BITS)
        for limb, part in enumerate(parts):
            held = self.limbs.setdefault(limb, np.zeros((self.groups, self.width), np.int64))
            held += (marks @ part).astype(np.int64)

    def rows(self, first: int = 0) -> pa.RecordBatch:
        """One row per number that is not zero: group (from `first`), limb (-1: the size), place, value."""
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for limb, held in [(-1, self.sizes[:, None]), *self.limbs.items()]:
            group, place = np.nonzero(held)
            for column, values in zip(columns, (group + first, np.full(len(group), limb), place, held[group, place]), strict=True):
                column.append(values)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in columns], ["grp", "limb", "place", "value"])


SUMS = "grp long, limb long, place long, value long"


def means(parts: DataFrame, groups: int, width: int) -> dict[int, list[int]]:
    """Componentwise floor(sum / size) of every group with members. `parts` (see SUMS) is added up by Spark; the driver gets
    one row per group, limb and component."""
    totals = parts.groupBy("grp", "limb", "place").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    sums, sizes = [[0] * width for _ in range(groups)], [0] * groups
    for group, limb, place, value in totals:
        if limb < 0:
            sizes[group] = int(value)
        else:
            sums[group][place] += int(value) << (SUM_BITS * limb)
    return {g: [s // sizes[g] for s in sums[g]] for g in range(groups) if sizes[g]}


def batched(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of one Arrow batch as one of a task's batches."""
    return lambda batches: map(work, batches)


def rows_of(values: list[list[int]]) -> np.ndarray:
    """Integers as an int64 matrix, or as Python integers if one does not fit."""
    wide = any(not -(1 << 61) < v < 1 << 61 for row in values for v in row)
    return np.array(values, object if wide else np.int64).reshape(len(values), len(values[0]) if values else 0)


def total(figure: str) -> Column:
    """Sum of longs as a long; null where a figure is missing or the sum does not fit."""
    exact = F.sum(F.col(figure).cast("decimal(38,0)"))
    return F.when(F.count(figure) == F.count("*"), F.coalesce(exact, F.lit(0)).try_cast("long"))


def with_totals(rows: DataFrame, totals: DataFrame, key: str, spread_by: str, parts: int = 64) -> DataFrame:
    """Left join of a row per `key` (nulls are alike) to all its rows, which may be a third of the table.

    At most LISTED totals are broadcast; more are repeated for `parts` parts of each key's rows."""
    totals = totals.withColumnRenamed(key, "__key")
    same = F.col(key).eqNullSafe(F.col("__key"))
    if totals.limit(LISTED + 1).count() <= LISTED:
        return rows.join(F.broadcast(totals), same, "left").drop("__key")
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(spread_by), F.lit(parts)))
    repeated = totals.withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return dealt.join(repeated, same & (F.col("__part") == F.col("__at")), "left").drop("__key", "__part", "__at")
