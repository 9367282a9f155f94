"""Vector operators against plain integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from casebook.llm import centroids, integers, product_codes

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.StringType()),
        *[T.StructField(name, T.StringType()) for name in ("code", "error", "cluster", "part", "dots", "ints")],
    ]
)


def vectors(width, scale=1.0, n=150, odd=True):
    rng = random.Random(width)
    rows = [(i, [rng.gauss(i % 5, 1) * scale for _ in range(width)], "ab"[i % 2] if i % 7 else None) for i in range(n)]
    if odd:
        plain = rows[3][1]
        rows += [(3, plain, "a"), (3, plain, "a"), (None, plain, None), (None, rows[4][1], "b"), (n, None, "a"), (n + 1, [None, *plain[1:]], "a")]
        rows += [(n + 2, [float("nan"), *plain[1:]], None), (n + 3, [*plain[1:], float("-inf")], "b"), (n + 4, [0.0] * width, "b")]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*row, *["clash"] * 6) for row in rows], VECTORS)


def usable(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def nearest(row, entries):
    return min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), at) for at, e in enumerate(entries))


def refined(rows, entries, rounds):
    for _ in range(rounds):
        groups = {}
        for row in rows:
            groups.setdefault(nearest(row, entries)[1], []).append(row)
        entries = [[sum(c) // len(groups[at]) for c in zip(*groups[at], strict=True)] if at in groups else e for at, e in enumerate(entries)]
    return entries


def whole(x, factor):
    return math.floor(x * factor) if abs(x) < 2.0**50 else int(x) * factor


@pytest.mark.parametrize("scale", [0.1, 1e5, 1e25])
def test_codes_match_plain_integers(spark, scale):
    rows = vectors(16, scale)
    got = product_codes.compress(table(spark, rows)).collect()
    kept = [(i, [whole(x, 4096) for x in v], label) for i, v, label in usable(rows)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [refined([r[1][2 * p : 2 * p + 2] for r in kept], [r[1][2 * p : 2 * p + 2] for r in order[:16]], 6) for p in range(8)]
    digest = hashlib.sha256(",".join(str(v) for part in books for e in part for v in e).encode()).hexdigest()
    found, totals = [], Counter()
    for i, v, label in kept:
        near = [nearest(v[2 * p : 2 * p + 2], books[p]) for p in range(8)]
        error = sum(d for d, _ in near)
        totals[label] += error
        found.append((i, "".join(f"{at:02x}" for _, at in near), error, label))

    def fits(figure):
        return figure if figure < 1 << 63 else None

    want = [(i, code, fits(error), fits(totals[label]), digest) for i, code, error, label in found]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_codes_of_other_lengths_few_rows_and_none(spark):
    rows = [(5, [1.0, 2.0], "a"), (6, [0.5] * 8, "a"), (7, [], None), (8, [1.5] * 8, None)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in product_codes.compress(table(spark, rows)).collect()}
    assert got == {5: (None, None, 0), 6: ("00" * 8, 0, 0), 7: (None, None, 0), 8: ("01" * 8, 0, 0)}
    empty = product_codes.compress(table(spark, []))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0


def test_codes_decode_to_their_entries(spark):
    rows = table(spark, vectors(16, 0.1, odd=False))
    books = product_codes.train(rows)
    coded = product_codes.encode(rows, books)
    for row in product_codes.decode(coded, books).collect():
        entries = [books.entries[p][int(row.code[2 * p : 2 * p + 2], 16)] for p in range(8)]
        assert row.approx == [v / 4096 for e in entries for v in e]


@pytest.mark.parametrize("scale", [0.1, 1e5, 1e25])
def test_clusters_match_plain_integers(spark, scale):
    rows = vectors(64, scale, 120) + [(900, [1.0] * 63, "a"), (901, [], "a")]
    got = centroids.cluster_report(table(spark, rows)).collect()
    kept = [(i, [whole(x, 64) for x in v]) for i, v, _ in usable(rows) if len(v) == 64]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    final = refined([v for _, v in kept], [v for _, v in order[:16]], 3)
    near = [(i, *nearest(v, final)) for i, v in kept]
    sums = Counter()
    for _, d, c in near:
        sums[c] += d

    def fits(figure):
        return figure if figure < 1 << 63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    want = [(i, c, fits(d), fits(sums[c]), fits(sum(sums.values())), digests[c]) for i, d, c in near]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_clusters_of_few_rows_and_none(spark):
    two = centroids.cluster_report(table(spark, [(1, [0.5] * 64, None), (2, [0.25] * 64, None)])).collect()
    assert {r.distance for r in two} == {0} and {r.cluster for r in two} == {0, 1}
    assert centroids.cluster_report(table(spark, [(None, [0.5] * 64, None)])).collect()[0].cluster is None
    assert centroids.cluster_report(table(spark, [])).count() == 0


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(5)
    for top in (1 << 10, 1 << 27, 1 << 35, 1 << 60):
        a, b = rng.integers(-top, top, (40, 9)), rng.integers(-top, top, (7, 9))
        assert (integers.product(a, b).astype(object) == a.astype(object) @ b.astype(object).T).all()
        old, new = rng.integers(-top, top, (7, 9)), b.copy()
        new[:, ::2] = old[:, ::2]
        assert (centroids.update(a, integers.product(a, old), new - old).astype(object) == a.astype(object) @ new.astype(object).T).all()


def test_many_totals_join_like_few(spark, monkeypatch):
    rows = table(spark, vectors(8, 0.1))
    totals = rows.groupBy("label").count()
    few = sorted(map(str, integers.with_totals(rows.select("vec_id", "label"), totals, "label", "vec_id").collect()))
    monkeypatch.setattr(integers, "LISTED", 0)
    assert sorted(map(str, integers.with_totals(rows.select("vec_id", "label"), totals, "label", "vec_id").collect())) == few
