"""SimHash near-duplicates found by multi-index hashing over fingerprint segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.components import components
from casebook.llm.storage import discard, stored

#: Two segments of 32 bits: fingerprints within 3 bits agree in one of them up to 1 bit.
SEGMENT, RADIUS, BALL = 32, 3, 1
#: Buckets of more fingerprints are linked through shared neighbours instead of pairs.
DENSE = 2_000


def simhash(text: bytes, width: int = 3) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half the shingles' hashes; 0 if there are no words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        shingles = [joined]
    else:
        stops = np.cumsum([len(word) + 1 for word in words]) - 1
        starts = [0, *(stops[: 1 - width - 1] + 1).tolist()] if width > 1 else [0, *(stops[:-1] + 1).tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, stops[width - 1 :].tolist(), strict=True)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(shingle, 42) for shingle in shingles], "<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of `docs` (without text) and fp, the signed 64-bit SimHash of column text."""
    names = [c for c in docs.columns if c != "text"]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [simhash(text.encode() if text else b"") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(np.array(prints, np.uint64).view(np.int64))], [*names, "fp"])

    kinds = [f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names]
    return docs.mapInArrow(sign, ", ".join([*kinds, "fp long"]))


def _segment(fp, at: int):
    return F.shiftrightunsigned(fp, at * SEGMENT).bitwiseAND((1 << SEGMENT) - 1)


def _keys(prints: DataFrame) -> DataFrame:
    """key, fp, visits: each fingerprint in the table of each segment, and the tables it visits for its Hamming ball.

    Of two segments that differ in one bit only the one with the bit set visits the other."""
    rows = []
    for at in range(64 // SEGMENT):
        own, table = f"shiftrightunsigned(fp, {at * SEGMENT}) & {(1 << SEGMENT) - 1}L", f"{at << 40}L"
        set_bits = f"filter(sequence(0, {SEGMENT - 1}), b -> getbit({own}, b) = 1)"
        rows.append(F.expr(f"array(struct({table} + ({own}) AS key, false AS visits))"))
        rows.append(F.expr(f"transform({set_bits}, b -> struct({table} + (({own}) ^ shiftleft(1L, b)) AS key, true AS visits))"))
    return prints.select("fp", F.inline(F.concat(*rows))).select("key", "fp", "visits")


def _through_neighbours(rows: DataFrame, others: int) -> DataFrame:
    """Links inside buckets of many fingerprints, one per row and shared neighbour.

    Rows of a bucket lie within 3 bits of one another if a value exists within 1 bit of one and 2 of the other (1 and
    1, if one of them visits). All who share a value are linked to the least owner within 1 bit, which is within 3."""
    rest = _segment(F.col("fp"), others)
    single = F.concat(F.array(F.lit(0).cast("long")), *[F.array(F.lit(1 << b)) for b in range(SEGMENT)])
    double = F.array(*[F.lit(1 << a | 1 << b) for a in range(SEGMENT) for b in range(a)])
    near = rows.select("key", "fp", "visits", F.explode(single).alias("flip"), F.lit(True).alias("near"))
    far = rows.where("not visits").select("key", "fp", "visits", F.explode(double).alias("flip"), F.lit(False).alias("near"))
    spread = near.unionByName(far).withColumn("value", rest.bitwiseXOR(F.col("flip")))
    hubs = spread.where("near and not visits").groupBy("key", "value").agg(F.min("fp").alias("hub"))
    return spread.join(hubs, ["key", "value"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))


def near_links(prints: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that keep every pair within 3 bits connected."""
    return _links(stored(_keys(prints)))


def _links(keys: DataFrame) -> DataFrame:
    """a, b: the links that the tables of segments (key, fp, visits) give."""
    tables = keys.where("not visits")
    dense = tables.groupBy("key").count().where(F.col("count") > DENSE).select("key")
    sparse = keys.join(dense, "key", "left_anti")
    owners = tables.join(dense, "key", "left_anti").select("key", F.col("fp").alias("owner"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("owner"))) <= RADIUS
    pairs = sparse.join(owners, "key").where((F.col("visits") | (F.col("fp") > F.col("owner"))) & apart)
    links = pairs.select(F.col("fp").alias("a"), F.col("owner").alias("b"))
    crowded = keys.join(dense, "key", "left_semi")
    for at in range(64 // SEGMENT):
        links = links.unionByName(_through_neighbours(crowded.where(F.shiftright("key", 40) == at), 1 - at))
    return links


def clustered(docs: DataFrame) -> DataFrame:
    """The columns of `docs` (without text), fp, root and component_id for every row.

    Rows of equal fingerprints and of fingerprints linked at 3 or fewer bits, directly or through others, share root
    (a fingerprint) and component_id (their smallest doc_id; null if none has one). Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows get the same answer."""
    rows = stored(fingerprints(docs))
    groups = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    keys = stored(_keys(groups.select("fp")))
    roots = stored(components(_links(keys)))
    discard(keys)
    rooted = groups.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.select("fp", "root").join(least, "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id for every row of `docs`."""
    found = clustered(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame] = clustered) -> DataFrame:
    """`docs` with one row of each group (rows that `grouped` gives one root): that of the smallest doc_id (then of the smallest hash of
    its text; rows without an id last). Columns are as before; of repeated rows one stays."""
    names = docs.columns
    text_key, id_key = F.xxhash64("text", "doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    slim = docs.select("doc_id", "text", text_key.alias("__text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("__text").alias("text"))
    first = grouped(slim).groupBy("root").agg(F.min(order).alias("row"))
    kept = first.select(F.col("row.text").alias("__text"), F.coalesce(F.col("row.doc_id").cast("long"), F.lit(0).cast("long")).alias("__id"))
    marked = docs.withColumns({"__text": text_key, "__id": id_key})
    return marked.join(kept, ["__text", "__id"], "left_semi").dropDuplicates(["__text", "__id"]).select(*names)
