"""Language identification with blended-spectrum string kernels, Nystroem landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lengths of the character n-grams and the number of hashed n-gram features.
ORDERS, FEATURES = (1, 2, 3, 4), 1 << 16
_MIX = np.uint32(0x9E3779B1)


def presence(texts: list[str]) -> Iterator[np.ndarray]:
    """For groups of texts, a 0/1 matrix of which hashed n-grams of any order each lower-cased text holds."""
    for at in range(0, len(texts), 64):
        part = [text.lower() for text in texts[at : at + 64]]
        matrix = np.zeros((len(part), FEATURES), np.float32)
        flat = matrix.reshape(-1)
        sizes = np.array([len(text) for text in part])
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(len(part), dtype=np.int64) * FEATURES, sizes)
        grams = np.zeros(len(codes), np.uint32)
        for order in range(1, max(ORDERS) + 1):
            grams = (grams[: len(codes) - order + 1] * np.uint32(0x01000193) ^ codes[order - 1 :]) * _MIX
            if order in ORDERS and len(grams):
                hashed = ((grams + np.uint32(order)) * _MIX >> np.uint32(16)).astype(np.int64)
                whole = row[: len(grams)] == row[order - 1 :]
                flat[(row[: len(grams)] + hashed)[whole]] = 1.0
        yield matrix


def normalised(matrix: np.ndarray) -> np.ndarray:
    """Rows of unit length, so that a product of two is the normalised presence kernel."""
    return matrix / np.sqrt(np.maximum(matrix.sum(axis=1, keepdims=True), 1.0))


@dataclass
class Model:
    """weights: features x languages, the landmarks and the Nystroem map folded in."""

    languages: list[str]
    weights: np.ndarray
    steepness: float = 6.0

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], landmarks: int, ridge: float) -> Model:
        """Presence is kept as bits and multiplied a block at a time, so that many languages fit in memory."""
        languages = sorted(set(labels))
        bits = np.concatenate([np.packbits(m > 0, axis=1) for m in presence(texts)])
        chosen = [i for lang in languages for i in [j for j, x in enumerate(labels) if x == lang][:landmarks]]

        def blocks(rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
            for at in range(0, len(rows), 512):
                yield slice(at, at + 512), normalised(np.unpackbits(rows[at : at + 512], axis=1).astype(np.float32))

        kernel = np.empty((len(bits), len(chosen)), np.float32)
        for across, basis in blocks(bits[chosen]):
            for down, rows in blocks(bits):
                kernel[down, across] = rows @ basis.T
        values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
        kept = values > values[-1] * 1e-6
        root = vectors[:, kept] / np.sqrt(values[kept])
        mapped = kernel.astype(np.float64) @ root
        target = np.where(np.array(labels)[:, None] == np.array(languages), 1.0, -1.0)
        share = (target > 0).mean(axis=0)
        target = np.where(target > 0, 1.0, -share / np.maximum(1 - share, 1e-9))
        solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ target)
        each = (root @ solved).astype(np.float32)
        return cls(languages, sum(basis.T @ each[across] for across, basis in blocks(bits[chosen])))

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """The language of the highest ridge output, and its softmax share."""
        names, scores = [], []
        for matrix in presence(texts):
            out = (normalised(matrix) @ self.weights).astype(np.float64)
            share = np.exp(self.steepness * (out - out.max(axis=1, keepdims=True)))
            share /= share.sum(axis=1, keepdims=True)
            best = out.argmax(axis=1)
            names += [self.languages[i] for i in best]
            scores += share[np.arange(len(best)), best].tolist()
        return names, scores


def held_out(doc_id):
    """Whether a document is kept out of learning; one without an id is neither learnt from nor held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = 300, landmarks: int = 48, ridge: float = 0.3) -> Model | None:
    """Fit on a sample: at most `per_language` labelled documents of every language, of distinct texts, drawn by a hash
    of their text, those over 100,000 characters last. None if nothing is labelled."""
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    labelled = docs.select("doc_id", "lang", "text").where(learnt & F.col("lang").isNotNull() & F.col("text").isNotNull())
    # hashes below a bound that lets some four times the sample through; copies of a text count once, here and there
    hashed = labelled.select("doc_id", "lang", "text", F.xxhash64("text").alias("drawn"))
    distinct = hashed.select("lang", "drawn").distinct().groupBy("lang").count()
    bound = F.lit(4 * per_language + 100) / F.col("count")
    near = hashed.join(F.broadcast(distinct), "lang").where(F.pmod("drawn", F.lit(1 << 40)) / float(1 << 40) < bound)
    slim = near.groupBy("lang", "drawn").agg(F.min("doc_id").alias("doc_id"), F.max(F.length("text") > 100_000).alias("long"))
    order = Window.partitionBy("lang").orderBy("long", "drawn", "doc_id")
    sample = slim.withColumn("at", F.row_number().over(order)).where(F.col("at") <= per_language)
    rows = hashed.join(F.broadcast(sample.select("doc_id", "lang", "drawn", "at")), ["doc_id", "lang", "drawn"])
    found = rows.groupBy("lang", "at").agg(F.first("text").alias("text")).orderBy("at", "lang").collect()
    return Model.fit([r["text"] for r in found], [r["lang"] for r in found], landmarks, ridge) if found else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of `docs`.

    Texts that are null, empty or without any letter are `und` with score 0, and so is all if no language was learnt.
    Repeated rows get the same answer. The model (features x languages) is broadcast; its size follows
    from the number of languages, not from the rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            letters = [i for i, text in enumerate(texts) if any(map(str.isalpha, text))]
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            if sent.value and letters:
                for i, name, score in zip(letters, *sent.value.predict([texts[i] for i in letters]), strict=True):
                    names[i], scores[i] = name, score
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
