"""Connected components: right roots in few rounds, without a table left for each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from casebook.llm import components as module
from casebook.llm.components import components, stars


def _links(spark, pairs, parts):
    return spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long").repartition(parts)


def test_long_chain_replaces_its_tables(spark, monkeypatch):
    written, gone = [], []
    store, discard = module.stored, module.discard
    monkeypatch.setattr(module, "stored", lambda df: written.append(store(df)) or written[-1])
    monkeypatch.setattr(module, "discard", lambda table: gone.append(table) or discard(table))
    chain = [(at, at + 1) if at % 3 else (at + 1, at) for at in range(-200, 200)]
    found = components(_links(spark, chain, 5))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(node, -200) for node in range(-200, 201)}
    # all but the last are discarded, in the order in which they were written
    assert len(written) > 1 and all(a is b for a, b in zip(written[:-1], gone, strict=True))


def test_random_links_match_brute_force(spark):
    pairs = np.random.default_rng(3).integers(-150, 150, (170, 2)).tolist()
    pairs += pairs[:20] + [(7, 7), (2**62, -(2**63)), (2**63 - 1, 2**62)]
    root = {node: node for pair in pairs if pair[0] != pair[1] for node in pair}
    for _ in root:
        for a, b in pairs:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    rows = components(_links(spark, pairs, 4)).collect()
    assert len(rows) == len(root) and {r["node"]: r["root"] for r in rows} == root


def test_no_links_give_no_rows(spark):
    assert components(_links(spark, [], 1)).count() == 0
    assert components(spark.range(3).select(F.col("id").alias("a"), F.col("id").alias("b"))).count() == 0


def test_stars_of_a_part():
    leaves, roots = stars(np.array([5, 4, 9, 9]), np.array([4, 2, 8, 9]))
    assert dict(zip(leaves.tolist(), roots.tolist(), strict=True)) == {4: 2, 5: 2, 9: 8}
