"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

Counts of all trusted text are summed per task, then by Spark; continuation counts, context totals and lower-order
probabilities meet in joins on the n-gram, sharded by it. For scoring, the finished tables are split by the two
characters before the last one: the n-gram, its suffixes and their contexts then lie in one shard, so each position of
a text is scored by one shard alone. Shards are of a checked, bounded size and are broadcast one after another; a
document's log-probability is the sum of what they give."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.hashing import FACTOR, mix
from casebook.llm.storage import stored

ORDER = 5
START, END = "\x02", "\x03"
#: Entries of a shard; about 16 bytes each.
SHARD = 3_000_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of padded texts, the first place of each whole n-gram, and the text it belongs to."""
    padded = "".join([START * (ORDER - 1) + text + END for text in texts])
    sizes = np.array([len(text) + 1 for text in texts])
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) + owner * (ORDER - 1)
    return codes, place, owner


def _hash(codes: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    total = np.full(len(start), length, np.uint64)
    for k in range(length):
        total = total * FACTOR + codes[start + k] + np.uint64(1)
    return mix(total)


def _hash_text(grams: list[str]) -> np.ndarray:
    out = np.zeros(len(grams), np.uint64)
    sizes = np.array([len(gram) for gram in grams])
    for length in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == length)
        codes = np.frombuffer("".join(grams[i] for i in mine.tolist()).encode("utf-32-le"), np.uint32)
        out[mine] = _hash(codes, np.arange(len(mine)) * length, length)
    return out


def _groups(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def count_grams(texts: DataFrame) -> DataFrame:
    """gram, n: the n-grams of the highest order in column text, null and empty texts being START and END only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups([text or "" for text in batch.column(0).to_pylist()], 1 << 21):
                codes, place, _ = _codes(group)
                _, first, n = np.unique(_hash(codes, place, ORDER), return_index=True, return_counts=True)
                windows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[place[first]]
                flat = windows.tobytes().decode("utf-32-le")
                grams = [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], ["gram", "n"])

    return texts.select("text").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, kept within the counts they are taken from."""
    n1, n2, n3, n4 = (x or 0 for x in grams.agg(*[F.sum(F.when(F.col("n") == k, 1)) for k in (1, 2, 3, 4)]).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratios = [n2 / n1 if n1 else 0.5, n3 / n2 if n2 else 0.5, n4 / n3 if n3 else 0.5]
    return tuple(min(k - 0.01, max(0.05, k - (k + 1) * y * r)) for k, r in zip((1, 2, 3), ratios, strict=True))


@dataclass
class Tables:
    """grams (gram, value): log-probability of the last character after the others; contexts (gram, value): log weight
    of the next lower order; unknown: log-probability of a character never seen."""

    grams: DataFrame
    contexts: DataFrame
    unknown: float


def fit(trusted: DataFrame) -> Tables | None:
    """The model of column text of the trusted rows, None if there are none."""
    counts = [stored(count_grams(trusted))]
    while len(counts) < ORDER:  # an n-gram counts as often as there are characters before it
        counts.append(stored(counts[-1].groupBy(F.substring("gram", 2, ORDER).alias("gram")).agg(F.count("*").alias("n"))))
    letters = counts[-1].count()
    if not letters:
        return None
    grams = contexts = None
    lower, unknown = None, 0.0
    for length, table in enumerate(reversed(counts), 1):
        d1, d2, d3 = _discounts(table)
        n = F.col("n")
        taken = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        split = table.select("gram", n, taken.alias("taken"), F.substring("gram", 1, length - 1).alias("context"))
        totals = split.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("spare"))
        joined = split.join(totals, "context").withColumn("weight", F.col("spare") / F.col("total"))
        if lower is None:
            total, spare = totals.select("total", "spare").first()
            unknown = spare / total / (letters + 1)
            joined = joined.withColumn("below", F.lit(1.0 / (letters + 1)))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            joined = joined.withColumn("suffix", F.substring("gram", 2, ORDER)).join(below, "suffix")
        lower = stored(joined.select("gram", ((n - F.col("taken")) / F.col("total") + F.col("weight") * F.col("below")).alias("p")))
        valued = lower.select("gram", F.log("p").alias("value"))
        grams = valued if grams is None else grams.unionByName(valued)
        if length > 1:
            weights = totals.select(F.col("context").alias("gram"), F.log(F.col("spare") / F.col("total")).alias("value"))
            contexts = weights if contexts is None else contexts.unionByName(weights)
    return Tables(grams, contexts, math.log(unknown))


class Lookup:
    """Values by 64-bit key: sorted keys under an index of their leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, (4 * len(keys)).bit_length()))
        slots = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.index = np.searchsorted(self.keys >> self.shift, slots).astype(np.int32)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values (0 if not)."""
        slot = (wanted >> self.shift).astype(np.int64)
        at, stop = self.index[slot].astype(np.int64), self.index[slot + 1]
        found, values = np.zeros(len(wanted), bool), np.zeros(len(wanted), np.float32)
        left = np.flatnonzero(at < stop)
        while len(left):
            hit = self.keys[at[left]] == wanted[left]
            found[left[hit]] = True
            values[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < stop[left]]
        return found, values


@dataclass
class Shard:
    """One part of the model: it scores the places whose two characters before the last fall to it."""

    grams: Lookup
    contexts: Lookup
    unknown: float
    number: int
    of: int

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log-probabilities of its places, and the number of all places, per text."""
        codes, place, owner = _codes(texts)
        sizes = np.bincount(owner, minlength=len(texts))
        if self.of > 1:
            mine = _hash(codes, place + ORDER - 3, 2) % np.uint64(self.of) == self.number
            place, owner = place[mine], owner[mine]
        total = np.zeros(len(place))
        left = np.arange(len(place))
        for length in range(ORDER, 0, -1):
            found, value = self.grams.find(_hash(codes, place[left] + ORDER - length, length))
            total[left] += value
            left = left[~found]
            if not len(left):
                break
            if length > 1:
                total[left] += self.contexts.find(_hash(codes, place[left] + ORDER - length, length - 1))[1]
            else:
                total[left] += self.unknown
        return np.bincount(owner, total, len(texts)).astype(np.float64), sizes


def shards(tables: Tables, most: int = SHARD) -> Iterator[Shard]:
    """The model in parts of at most `most` entries, checked before any is fetched."""
    spark = tables.grams.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, kind = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            routes = [gram[-3:-1] if k == 0 else gram[-2:] for gram, k in zip(grams, kind.tolist(), strict=True)]
            route = np.zeros(len(grams), np.uint64)
            long = np.array([len(r) == 2 for r in routes], bool)
            if long.any():
                route[long] = _hash_text([r for r in routes if len(r) == 2])
            columns = [pa.array(_hash_text(grams).view(np.int64)), batch.column(1), batch.column(2), pa.array(route.view(np.int64)), pa.array(~long)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "value", "kind", "route", "everywhere"])

    both = tables.grams.withColumn("kind", F.lit(0)).unionByName(tables.contexts.withColumn("kind", F.lit(1)))
    entries = stored(both.select("gram", "value", "kind").mapInArrow(hashed, "key long, value double, kind int, route long, everywhere boolean"))
    parts = max(1, -(-entries.count() // most))

    def part(parts: int):
        return F.pmod(F.pmod(F.shiftrightunsigned("route", 1), F.lit(parts)) * 2 + F.col("route").bitwiseAND(1), F.lit(parts))

    while parts > 1 and parts < 1 << 16:
        largest = entries.where("not everywhere").groupBy(part(parts).alias("part")).count().agg(F.max("count")).first()[0]
        if (largest or 0) <= most:
            break
        parts *= 2
    for number in range(parts):
        rows = entries.where(F.col("everywhere") | (part(parts) == number)).select("key", "value", "kind").toArrow()
        key, value, kind = (rows.column(i).to_numpy() for i in range(3))
        key = key.view(np.uint64)
        yield Shard(Lookup(key[kind == 0], value[kind == 0]), Lookup(key[kind == 1], value[kind == 1]), tables.unknown, number, parts)


def perplexities(docs: DataFrame, tables: Tables | None) -> DataFrame:
    """doc_id, text_key (a hash of text and id), lang, n (characters and END), perplexity of every distinct row of `docs` (doc_id, lang, text).

    Without a model every perplexity is 1. A null text is empty: one END."""
    rows = docs.select("doc_id", F.xxhash64("text", "doc_id").alias("text_key"), "lang", "text")
    if tables is None:
        return rows.select("doc_id", "text_key", "lang", (F.coalesce(F.length("text"), F.lit(0)) + 1).alias("n"), F.lit(1.0).alias("perplexity")).distinct()
    parts = []
    for shard in shards(tables):
        sent = docs.sparkSession.sparkContext.broadcast(shard)

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [sent.value.score(group) for group in _groups([t or "" for t in batch.column(3).to_pylist()])]
                logs, sizes = (np.concatenate([s[i] for s in scores]) if scores else np.zeros(0) for i in range(2))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(logs, pa.float64()), pa.array(sizes.astype(np.int64))], ["doc_id", "text_key", "lang", "log", "n"])

        kind = docs.schema["lang"].dataType.simpleString()
        part = rows.mapInArrow(score, f"doc_id long, text_key long, lang {kind}, log double, n long").withColumn("shard", F.lit(shard.number))
        parts.append(part if shard.of == 1 else stored(part))
        if shard.of > 1:
            sent.unpersist()
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    once = scored.groupBy("doc_id", "text_key", "lang", "shard").agg(F.max("log").alias("log"), F.max("n").alias("n"))
    whole = once.groupBy("doc_id", "text_key", "lang").agg(F.sum("log").alias("log"), F.max("n").alias("n"))
    return whole.select("doc_id", "text_key", "lang", "n", F.exp(-F.col("log") / F.col("n")).alias("perplexity"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, slack: float = 1.5, least: int = 50, prior: int = 30) -> DataFrame:
    """doc_id, text_key, lang, perplexity, smoothed, threshold, accepted for every distinct row of `docs`.

    Trusted are documents labelled quality 1 and not labelled toxic. The model is trained on four fifths of them, by
    a hash of their id, and the rest set the thresholds: a language's is the `quantile` of their smoothed perplexities
    times `slack`; a language (null included) with fewer than `least` of them takes that of all. Smoothed is the
    perplexity after `prior` more characters at the median perplexity of trusted text, so that a few characters
    alone reject nothing. Without trusted text everything is accepted. Null and empty texts and repeated rows are
    scored alike."""
    ids = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    fold = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5))
    # labels grow with the corpus, so they are never broadcast, however few there are
    tables = fit(docs.select("doc_id", "text").join(ids.where(fold != 0).hint("merge"), "doc_id", "left_semi"))
    scored = stored(perplexities(docs, tables))
    trusted = scored.join(ids.where(fold == 0), "doc_id", "left_semi")
    median = trusted.agg(F.coalesce(F.percentile_approx("perplexity", 0.5, 10_000), F.lit(1.0))).first()[0]
    smoothed = F.exp((F.log("perplexity") * F.col("n") + prior * math.log(median)) / (F.col("n") + prior))
    level = F.percentile_approx(smoothed, quantile, 10_000) * slack
    by_lang = trusted.groupBy("lang").agg(level.alias("own"), F.count("*").alias("held")).where(F.col("held") >= least)
    by_lang = by_lang.select(F.struct("lang").alias("spoken"), "own")
    overall = trusted.agg(level.alias("all")).first()[0]
    judged = scored.withColumn("spoken", F.struct("lang")).join(by_lang, "spoken", "left")
    threshold = F.coalesce("own", F.lit(math.inf if overall is None else overall))
    accepted = smoothed <= threshold
    return judged.select("doc_id", "text_key", "lang", "perplexity", smoothed.alias("smoothed"), threshold.alias("threshold"), accepted.alias("accepted"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts; columns as before."""
    names = docs.columns
    rejected = judge(docs, labels).where("not accepted").select(F.col("text_key").alias("__text")).distinct()
    return docs.withColumn("__text", F.xxhash64("text", "doc_id")).join(rejected, "__text", "left_anti").select(*names)
