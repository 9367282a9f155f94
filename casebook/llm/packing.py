"""Documents packed into sequences of bounded length by best fit in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.storage import stored
from casebook.llm.token_store import word_encoder
from casebook.llm.units import byte_slices

CAPACITY = 2048
#: Fewer seeds than this of one length are named one by one; more are drawn by a hash of their number.
NAMED = 64


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and (if `ids`) ids, little-endian unsigned 32-bit bytes.

    Every row of `docs` (doc_id, text) is encoded whole and closed by `end_id`; null texts are empty. Only documents
    of more than `capacity` ids are cut, into pieces of that length, the last of which may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for texts in byte_slices(batch.column(1), 8 << 20):
                found, stops = encoder.encode(texts)
                rows = []
                for row in np.split(found, stops[:-1]):
                    raw, name = row.tobytes() + end, next(names)
                    for number, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((name, number, at // 4, len(part) // 4, zlib.crc32(part), part if ids else None))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + ids]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's share of a successor sweep over items and slots in ascending size.

    Waiting items lie on a stack, as runs of one length; each slot takes the item on top, the longest that fits. Rows
    out: pairs (rank -1); slots that found no item and items that found no slot, ranked from the one whose partner would
    be nearest in the tasks before and after."""
    part, stack, slots = TaskContext.get().partitionId(), [], 0

    def rows(rank, item, length, sequence, gap) -> pa.RecordBatch:
        n = len(rank)

        def column(values):
            return pa.nulls(n, pa.int64()) if values is None else pa.array(np.broadcast_to(np.asarray(values, np.int64), n))

        columns = [pa.array(np.full(n, part, np.int32)), *map(column, (rank, item, length, sequence, gap))]
        return pa.RecordBatch.from_arrays(columns, ["part", "rank", "item", "length", "sequence_id", "gap"])

    for batch in batches:
        size, kind, ident, gap = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        cuts = np.flatnonzero((np.diff(size) != 0) | (np.diff(kind) != 0)) + 1
        for at, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)], strict=True):
            if at < stop and kind[at] == 0:
                stack.append((int(size[at]), ident[at:stop]))
                continue
            while at < stop and stack:
                length, items = stack.pop()
                n = min(stop - at, len(items))
                yield rows(np.full(n, -1), items[len(items) - n :], length, ident[at : at + n], gap[at : at + n])
                if n < len(items):
                    stack.append((length, items[: len(items) - n]))
                at += n
            if at < stop:
                yield rows(slots + np.arange(stop - at), None, 0, ident[at:stop], gap[at:stop])
                slots += stop - at
    rank = 0
    while stack:
        length, items = stack.pop()
        yield rows(rank + np.arange(len(items))[::-1], items, length, None, None)
        rank += len(items)


def _across(counts: list) -> list[tuple[int, int, int, int, int]]:
    """What the tasks left over, matched over the whole order by rank: (items' task, first rank, slots' task, first rank, how
    many). Each task's slots precede its items there. `counts` has a row per task, so this is small."""
    slots = {r.part: r["n_slots"] for r in counts}
    items = {r.part: r["n_items"] for r in counts}
    waiting, found = [], []
    for part in sorted(slots):
        at = 0
        while at < slots[part] and waiting:
            source, rank, n = waiting.pop()
            take = min(n, slots[part] - at)
            found.append((source, rank, part, at, take))
            at += take
            if take < n:
                waiting.append((source, rank + take, n - take))
        if items[part]:
            waiting.append((part, 0, items[part]))
    return found


def _seeds(rest: DataFrame, lengths: dict[int, int], wanted: int, turn: int) -> tuple[Column, int]:
    """Which items open a sequence, the `wanted` longest, and the longest length that may be left.

    Each turn draws by another hash: those of one hash that an earlier turn left would be left again."""
    item, left = F.col("item"), wanted
    chosen = F.lit(False)
    for length in sorted(lengths, reverse=True):
        n = lengths[length]
        if not left:
            return chosen, length
        if n <= left:
            chosen, left = F.col("length") >= length, left - n
            continue
        mine = F.col("length") == length
        if left <= NAMED:
            named = [r.item for r in rest.where(mine).orderBy("item").limit(left).collect()]
            return chosen | (mine & item.isin(named)), length
        return chosen | (mine & (F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(1 << 30)) < F.lit(int((1 << 30) * left / n)))), length
    return chosen, 0


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, length, sequence_id for every row of `items` (item: distinct longs, length: 1 to `capacity`).

    Items of over half the capacity open a sequence each. In a round, items and the gaps of open sequences are
    range-sorted by size, and a sweep gives each gap the longest item not taken by a smaller gap; a gap that fits the
    longest item left several times is offered as so many slots. Pairs across tasks are settled by rank from the tasks'
    counts of left-overs. Then gaps shrink, and items longer than every gap open as many sequences as their total needs
    at least. The driver sees counts by length (at most `capacity` of them) and by task, never items."""
    half = capacity // 2
    opened = [items.where(F.col("length") > half).select("item", "length", F.col("item").alias("sequence_id"))]
    rest = items.where(F.col("length") <= half).select("item", "length")
    turn = 0
    gaps = opened[0].where(F.col("length") < capacity).select("sequence_id", (capacity - F.col("length")).alias("gap"))
    while lengths := {r.length: r["count"] for r in rest.groupBy("length").count().collect()}:
        least = min(lengths)
        room = {r.gap: r["count"] for r in gaps.where(F.col("gap") >= least).groupBy("gap").count().collect()}
        stuck = sum(length * n for length, n in lengths.items() if length > max(room, default=0))
        wanted = -(-stuck // capacity)
        turn += 1
        seed, longest = _seeds(rest, lengths, wanted, turn)
        seeds = rest.where(seed)
        if wanted:
            opened.append(seeds.select("item", "length", F.col("item").alias("sequence_id")))
            gaps = gaps.unionByName(seeds.select(F.col("item").alias("sequence_id"), (capacity - F.col("length")).alias("gap")))
        if not longest:
            break
        offers = -(-2 * sum(lengths.values()) // (sum(room.values()) + wanted))
        n_slots = F.greatest(F.lit(1), F.least(F.floor(F.col("gap") / longest), F.lit(offers))).cast("int")
        slots = gaps.where(F.col("gap") >= least).select("*", n_slots.alias("n")).select(
            F.floor(F.col("gap") / F.col("n")).alias("size"), F.lit(1).alias("kind"), F.col("sequence_id").alias("id"), "gap",
            F.explode(F.sequence(F.lit(1), F.col("n"))).alias("slot"),
        )
        waiting = rest.where(~seed).select(F.col("length").alias("size"), F.lit(0).alias("kind"), F.col("item").alias("id"), F.lit(0).cast("long").alias("gap"), F.lit(0).alias("slot"))
        order = ["size", "kind", "id", "slot"]
        swept = stored(
            waiting.unionByName(slots).repartitionByRange(*order).sortWithinPartitions(*order).drop("slot")
            .mapInArrow(_sweep, "part int, rank long, item long, length long, sequence_id long, gap long")
        )
        matched = swept.where("rank < 0").drop("part", "rank")
        idle, rest = swept.where("rank >= 0 and item is null"), swept.where("rank >= 0 and sequence_id is null")
        across = _across(swept.where("rank >= 0").groupBy("part").agg(F.count("sequence_id").alias("n_slots"), F.count("item").alias("n_items")).collect())
        if across:
            spans = F.broadcast(swept.sparkSession.createDataFrame(across, "source int, first long, target int, place long, many long"))
            inside = (F.col("part") == F.col("source")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many"))
            sent = rest.join(spans, inside, "left").select("item", "length", "target", (F.col("place") + F.col("rank") - F.col("first")).alias("to"))
            taken = idle.select(F.col("part").alias("target"), F.col("rank").alias("to"), "sequence_id", "gap")
            late = stored(sent.where("target is not null").join(taken, ["target", "to"]).drop("target", "to"))
            matched, rest = matched.unionByName(late), sent.where("target is null")
        opened.append(matched.select("item", "length", "sequence_id"))
        rest = rest.select("item", "length")
        used = matched.select("sequence_id", "gap", "length").unionByName(idle.select("sequence_id", "gap", "length"))
        gaps = stored(used.groupBy("sequence_id").agg((F.max("gap") - F.sum("length")).alias("gap")).where("gap > 0"))
    return reduce(DataFrame.unionByName, opened)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = True) -> DataFrame:
    """The columns of `pieces`, sequence_id and offset: each piece's sequence and its place there, gapless from 0.

    Every row of `docs` is packed: repeated rows and rows without doc_id as documents of their own, null and empty
    texts as the end id alone. Other columns are not read. `path` names the vocabulary on every executor."""
    cut = stored(pieces(docs, path, capacity, end_id, ids).withColumn("item", F.monotonically_increasing_id()))
    placed = best_fit(cut.select("item", "length"), capacity).drop("length")
    before = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset")
    return cut.join(placed, "item").select(*cut.drop("item").columns, "sequence_id", offset)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (the pieces' bytes joined), doc_ids and lengths in place order; a sequence is bounded by its capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("parts")
    joined = F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids")
    return packed.groupBy("sequence_id").agg(parts).select("sequence_id", joined, F.col("parts.doc_id").alias("doc_ids"), F.col("parts.length").alias("lengths"))
