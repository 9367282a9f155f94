"""Vectors compressed to product codes: codebooks refined by exact integer products on limbs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm import integers as it
from casebook.llm.storage import stored


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part, exact integers, and how a component becomes one: floor(factor * x)."""

    entries: list[list[list[int]]]
    width: int
    factor: int

    def digest(self) -> str:
        """sha256 of all components by part, entry and position, as decimal integers joined by commas."""
        return hashlib.sha256(",".join(str(v) for part in self.entries for entry in part for v in entry).encode()).hexdigest()

    def nearest(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each part: its number, its components of `rows`, the first nearest entry and the squared distance."""
        for at, entries in enumerate(self.entries):
            part = rows[:, at * self.width : (at + 1) * self.width]
            table = it.rows_of(entries)
            apart = it.squares(part)[:, None] + it.squares(table)[None, :] - 2 * it.product(part, table)
            code = apart.argmin(axis=1)
            yield at, part, code, apart[np.arange(len(part)), code]


def _usable(vectors: DataFrame, column: str, size: int) -> DataFrame:
    return vectors.where(it.finite(column) & (F.size(column) == size))


def train(vectors: DataFrame, column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, factor: int = 4096) -> Codebooks:
    """Codebooks of every part position, refined over all usable rows in every round.

    They start as the parts of the `entries` smallest vec_ids (repeated ids by their vectors; rows without an id last).
    Vectors have the length of the first usable one that can be cut into `parts`; no such row gives empty codebooks. Sums
    of assigned parts are added up per task, then by Spark; the driver gets one row per entry and component."""
    whole = vectors.where(it.finite(column) & (F.size(column) > 0) & (F.size(column) % parts == 0))
    first = whole.select("vec_id", F.size(column).alias("n"), column).orderBy(F.col("vec_id").asc_nulls_last(), column).limit(1).collect()
    if not first:
        return Codebooks([[] for _ in range(parts)], 0, factor)
    size = first[0].n
    width = size // parts
    used = _usable(vectors, column, size)
    seeds = used.select("vec_id", column).orderBy(F.col("vec_id").asc_nulls_last(), column).limit(entries).collect()
    start = it.floors(np.array([row[column] for row in seeds], np.float64), factor).tolist()
    books = Codebooks([[row[p * width : (p + 1) * width] for row in start] for p in range(parts)], width, factor)
    n = len(start)
    for _ in range(rounds):
        now = books

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = [it.Sums(n, width) for _ in range(parts)]
            for batch in batches:
                for at, part, code, _ in now.nearest(it.floors(it.matrix(batch.column(0), size), factor)):
                    sums[at].add(code, part)
            for at, held in enumerate(sums):
                yield held.rows(at * n)

        fresh = it.means(used.select(column).mapInArrow(assigned, it.SUMS), parts * n, width)
        books = Codebooks([[fresh.get(p * n + e, now.entries[p][e]) for e in range(n)] for p in range(parts)], width, factor)
    return books


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part) and error (squared distances summed) of every finite row.

    Rows whose vector is null or holds a null or a component that is not finite are dropped. Vectors of another length
    than the codebooks' have no code and no error; an error beyond a long is null."""
    size = books.width * len(books.entries)
    kept = vectors.where(it.finite(column)).select("vec_id", "label", column)
    kind = {name: vectors.schema[name].dataType.simpleString() for name in ("vec_id", "label")}
    other = kept.where(F.size(column) != size) if size else kept
    uncoded = other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not size:
        return uncoded

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = it.floors(it.matrix(batch.column(2), size), books.factor)
        code, error = np.zeros((len(rows), len(books.entries)), np.uint8), 0
        for at, _, nearest, apart in books.nearest(rows):
            code[:, at], error = nearest, error + apart
        digits = code.tobytes().hex()
        step = 2 * len(books.entries)
        texts = pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts, it.longs(error)], ["vec_id", "label", "code", "error"])

    schema = f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"
    return kept.where(F.size(column) == size).mapInArrow(it.batched(coded), schema).unionByName(uncoded)


def compress(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row kept by `encode`, after `train` over the same rows.

    label_error is the error summed over the coded rows of equal label, nulls together; null if there are none, or if it
    or one of them is beyond a long. Repeated rows give repeated rows; other columns are not read."""
    books = train(vectors, column)
    coded = stored(encode(vectors, books, column))
    totals = coded.where("code is not null").groupBy("label").agg(it.total("error").alias("label_error"))
    joined = it.with_totals(coded, totals, "label", "vec_id")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """The columns of `codes` and approx: the vector its code stands for, array<double>; null without a code."""
    size, step = books.width * len(books.entries), len(books.entries)
    tables = [np.array(part, np.float64) / books.factor for part in books.entries]
    names = codes.columns

    def restored(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for code in batch.column("code").to_pylist():
            at = bytes.fromhex(code) if code is not None and size else None
            found.append(None if at is None else np.concatenate([tables[p][at[p]] for p in range(step)]).tolist())
        return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.list_(pa.float64()))], [*names, "approx"])

    kinds = [f"`{n}` {codes.schema[n].dataType.simpleString()}" for n in names]
    return codes.mapInArrow(it.batched(restored), ", ".join([*kinds, "approx array<double>"]))
