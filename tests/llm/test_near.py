"""Near-dedup of the pipeline: pairs of similarity 0.8 and more against brute force."""

import random

import pytest

import corpus_pipeline
from casebook.llm import near, simhash
from tests.llm.samples import documents, prose, texts


def _set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def _edited(seed, words, edits):
    """A text and a copy with so many words replaced, far apart."""
    words = prose(seed, words).split()
    copy = list(words)
    for k in range(edits):
        copy[(2 * k + 1) * len(words) // (2 * edits)] = f"edit{seed}x{k}"
    return " ".join(words), " ".join(copy)


def test_copies_of_similarity_from_08_on_go_and_others_stay(spark):
    rows = []
    for k in range(60):
        rows += [(1000 + 2 * k + i, t) for i, t in enumerate(_edited(700 + k, 200, 1 + k % 6))]
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    for (a, left), (b, right) in zip(rows[::2], rows[1::2], strict=True):
        assert a in kept and (b in kept) == (_similarity(_set(left), _set(right)) < 0.8), b


@pytest.mark.parametrize("hubs", [1, 4])
def test_no_two_kept_rows_are_alike(spark, monkeypatch, hubs):
    """Also in a large bucket of copies, and whatever the number of hubs."""
    monkeypatch.setattr(near, "HUBS", hubs)
    base, rows = prose(5, 400).split(), texts()
    for k in range(40):
        copy, rng = list(base), random.Random(k)
        for _ in range(rng.choice([1, 12, 20, 30])):
            copy[rng.randrange(400)] = f"w{k}"
        rows.append((100 + k, " ".join(copy)))
    docs = documents(spark, rows)
    got = simhash.keep_one(docs, near.clustered)
    assert got.schema == docs.schema
    kept = [_set(r.text) for r in got.collect()]
    assert not [1 for i, a in enumerate(kept) for b in kept[:i] if _similarity(a, b) >= 0.8]
    for _, text in rows:
        assert any(_similarity(_set(text), k) >= 0.3 for k in kept)


def test_rows_of_bands_cover_08():
    rng = random.Random(1)
    met = 0
    for _ in range(300):
        shared, own = [rng.getrandbits(64) for _ in range(160)], [[rng.getrandbits(64) for _ in range(20)] for _ in range(2)]
        a, b = (near.np.unique(near.np.array(shared + o, near.np.uint64)) for o in own)
        met += bool((near.band_keys([a])[0] == near.band_keys([b])[0]).any())
    assert met >= 295  # similarity 0.8 exactly; 0.998 expected


def test_the_stage_also_drops_what_simhash_links(spark):
    """Two texts of one long refrain have one fingerprint, though their sets of shingles share little."""
    refrain = "over the hill " * 200  # three shingles: no bit is a tie
    rows = [(i, refrain + prose(60 + i, 40)) for i in range(2)]
    assert _similarity(*(_set(text) for _, text in rows)) < 0.8
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()] == [0]


def test_sets_of_too_different_sizes_are_not_fetched(spark, monkeypatch):
    """Of a bucket only pairs whose sizes allow the similarity reach the join with their sets."""
    fetched, alike = [], near._alike

    def counted(pairs, sets, least):
        fetched.extend((r.hub, r.node) for r in pairs.collect())
        return alike(pairs, sets, least)

    monkeypatch.setattr(near, "_alike", counted)
    sets = spark.createDataFrame([(n, list(range(size))) for n, size in ((1, 10), (2, 9), (3, 5))], "node long, shingles array<long>")
    buckets = spark.createDataFrame([(7, n, n, size) for n, size in ((1, 10), (2, 9), (3, 5))], "key long, node long, row long, size int")
    assert [(r.hub, r.node) for r in near._links(buckets, sets, 0.8).collect()] == [(1, 2)]
    assert fetched == [(1, 2)]


def _bucket(spark, contents):
    """A bucket of sets (node: shingles), least node first."""
    sets = spark.createDataFrame([(n, sorted(s)) for n, s in contents.items()], "node long, shingles array<long>")
    return spark.createDataFrame([(7, n, n, len(s)) for n, s in contents.items()], "key long, node long, row long, size int"), sets


def test_a_large_group_of_half_alike_sets_is_not_compared_pair_by_pair(spark, monkeypatch):
    """150 sets with three quarters in common: 11,175 pairs, none of similarity 0.8; the least is compared with all."""
    fetched, alike = [], near._alike

    def counted(pairs, sets, least):
        fetched.append(pairs.count())
        return alike(pairs, sets, least)

    monkeypatch.setattr(near, "_alike", counted)
    buckets, sets = _bucket(spark, {n: {*range(60), *range(100 * n + 100, 100 * n + 120)} for n in range(150)})
    assert near._links(buckets, sets, 0.8).count() == 0
    assert sum(fetched) == 149


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_rarest_shingles_lose_no_link(spark, monkeypatch, least):
    """Sets of one base at similarities around the bound, of several sizes; links are those of all pairs compared."""
    rng, contents = random.Random(11), {}
    for n in range(60):
        base = range(rng.choice([1, 5, 30, 36, 45]))
        contents[n] = {x if rng.random() > (n % 6) / 12 else rng.randrange(40, 90) for x in base}
    found = {}
    for crowd in (1, 10**6):
        monkeypatch.setattr(near, "CROWD", crowd)
        found[crowd] = sorted({(r.hub, r.node) for r in near._links(*_bucket(spark, contents), least).collect()})
    assert found[1] == found[10**6] and found[1]
    assert all(_similarity(contents[a], contents[b]) >= least for a, b in found[1])
