"""Small tables with every awkward case: nulls, empty and long texts, repeated rows, clashing column names."""

import random

from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in ("key", "hash", "fp", "bucket", "gram", "n", "start", "ids", "host", "items")],
    ]
)


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = ["the", "of", "and", "tion", "ing", "é", "ü", "ha", "re", "on", "st"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words)).capitalize() + "."


def texts() -> list[tuple[int | None, str | None]]:
    shared = prose(1, 60)
    long = prose(2, 6000)
    rows = [(i, prose(10 + i, 20 + 7 * i)) for i in range(25)]
    rows += [(30 + i, prose(100 + i, 15) + " " + shared + "\n" + prose(200 + i, 12)) for i in range(6)]
    rows += [(40, long), (41, long[:3000] + " changed " + long[3010:]), (42, shared), (43, shared), (44, "x" * 700), (45, "日本語の文章。" * 60)]
    rows += [(50, None), (51, ""), (52, " \n\t "), (53, "12 34!"), (54, "a"), (55, "  two  spaces \n here "), (56, "<|endoftext|> plain"), (57, "Ünï cödé’s é")]
    rows += [(60, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (None, None), (61, "same id " + prose(7, 30)), (61, prose(8, 40))]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, text, None if k % 7 == 6 else ("fr" if text and "é" in text else "en"), "s", len(text or ""), *["clash"] * 10) for k, (i, text) in enumerate(rows)]
    return spark.createDataFrame(data, DOCUMENTS)
