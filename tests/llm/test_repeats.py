"""Sketches, SimHash groups, repeated strings and decontamination against brute force."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casebook.llm import components, fm_index, prefix_free, simhash, sketches
from tests.llm.samples import documents, prose, texts


def _covered(rows):
    """Per row (doc_id, text): the bytes covered by a 100-byte string that starts earlier."""
    first, order = {}, [((-1 if i is None else i), (t or "").encode()) for i, t in rows]
    for doc, raw in order:
        for s in range(len(raw) - 99):
            key = raw[s : s + 100]
            first[key] = min(first.get(key, (doc, s)), (doc, s))
    out = []
    for doc, raw in order:
        hit = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            if first[raw[s : s + 100]] != (doc, s):
                hit[s : s + 100] = True
        out.append(hit)
    return out


def _want(rows):
    want = []
    for (doc_id, text), hit in zip(rows, _covered(rows), strict=True):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        spans = int((np.diff(hit.astype(int), prepend=0) == 1).sum())
        want.append((doc_id, len(raw), int(hit.sum()), spans, hashlib.sha256(raw[~hit].tobytes()).hexdigest()))
    return sorted(want, key=str)


@pytest.mark.parametrize(("hot", "parts", "dense"), [(48, 64, 20_000), (2, 3, 20_000), (48, 64, 1)])
def test_repeated_strings_match_brute_force(spark, monkeypatch, hot, parts, dense):
    """Whichever way the windows of a trigger are compared."""
    for name, value in (("HOT", hot), ("PARTS", parts), ("DENSE", dense)):
        monkeypatch.setattr(prefix_free, name, value)
    rows = texts() + [(70 + k, prose(300 + k, 9) + prose(1, 60)[5 * k : 330] + prose(400 + k, 9)) for k in range(12)]
    got = prefix_free.removal_digests(documents(spark, rows))
    assert sorted(map(tuple, got.collect()), key=str) == _want(rows)


@pytest.mark.parametrize(("hot", "dense"), [(48, 20_000), (2, 20_000), (48, 1)])
def test_rows_without_id_are_one_document(spark, monkeypatch, hot, dense):
    """Texts that share passages at one place, at shifted places, and with rows that have an id."""
    monkeypatch.setattr(prefix_free, "HOT", hot)
    monkeypatch.setattr(prefix_free, "DENSE", dense)
    shared = prose(1, 60)
    rows = [(None, shared[:150] + prose(500 + k, 12)) for k in range(5)] + [(None, prose(600 + k, 3 + k) + shared[k:260]) for k in range(5)]
    rows += [(None, prose(700, 9) + shared[40:300])] * 3 + [(k, prose(800 + k, 5) + shared[20 + k :]) for k in range(4)] + [(20, shared), (None, None), (None, "")]
    rows += [(None, shared[:150] + shared[3:150] + prose(900 + k, 4)) for k in range(3)]
    got = sorted(map(tuple, prefix_free.removal_digests(documents(spark, rows)).collect()), key=str)
    assert got == _want(rows)


def test_marks_of_rows_without_id_stay_with_their_text(spark):
    rows = [(None, prose(1, 40) + prose(5000 + k, 6)) for k in range(400)]
    keyed = prefix_free._keyed(documents(spark, rows))
    marks = prefix_free.repeats(keyed.select(F.col("__doc").alias("doc"), "text"))
    assert keyed.select("__doc").distinct().count() == 400
    assert (marks.groupBy("doc").count().agg(F.max("count")).first()[0] or 0) < 20


def test_long_texts_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(prefix_free, "CHUNK", 500)
    rows = texts()[:40]
    assert sorted(map(tuple, prefix_free.removal_digests(documents(spark, rows)).collect()), key=str) == _want(rows)


def test_removing_repeats_keeps_columns_and_whole_characters(spark):
    rows = [(1, "é" * 120), (2, "è" + "é" * 120 + "end"), (3, "short"), (4, None), (5, "é" * 120)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in prefix_free.remove_repeats(docs).collect()}
    assert prefix_free.remove_repeats(docs).schema == docs.schema
    # the first text repeats itself: all but its first 50 characters stand earlier in it
    assert got[3].text == "short" and got[4].text is None and 5 not in got
    assert got[2].text == "èend" and got[2].n_chars == 4


def test_equal_windows_follow_suffix_order():
    buffer = np.frombuffer((b"abcab" * 60) + bytes(range(100, 220)), np.uint8)
    at = np.arange(len(buffer) - 100)
    rank = prefix_free.equal_windows(buffer, at)
    windows = [buffer[i : i + 100].tobytes() for i in at]
    order = sorted(set(windows))
    assert rank.tolist() == [order.index(w) for w in windows]


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, far=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= far:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("dense", [2_000, 0])
def test_simhash_groups_match_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    base = prose(5, 300)
    rows = texts() + [(80 + k, base[: 200 * k] + prose(500 + k, 2) + base[200 * k :]) for k in range(8)]
    prints = [_fingerprint(t) for _, t in rows]
    least = defaultdict(list)
    for (doc_id, _), root in zip(rows, groups := _groups(prints), strict=True):
        least[root] += [] if doc_id is None else [doc_id]
    want = [(i, f"{p:016x}", min(least[g], default=None)) for (i, _), p, g in zip(rows, prints, groups, strict=True)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("dense", [2_000, 0])
def test_links_keep_near_fingerprints_connected(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(3)
    prints = {0, 2**64 - 1}
    for _ in range(12):
        center = int(rng.integers(0, 2**63))
        for _ in range(6):
            center ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            prints.add(center)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    links = simhash.near_links(frame)
    assert not [r for r in links.collect() if ((r.a ^ r.b) & (2**64 - 1)).bit_count() > 3]
    found = {r.node % 2**64: r.root for r in components.components(links).collect()}
    want = _groups(prints)
    got = [found.get(p, f"own {p}") for p in prints]
    assert len({(a, b) for a, b in zip(want, got, strict=True)}) == len(set(want)) == len(set(got))


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema
    groups = _groups([_fingerprint(t) for _, t in texts()])
    least = {}
    for (doc_id, _), group in zip(texts(), groups, strict=True):
        least[group] = min(least.get(group, math.inf), math.inf if doc_id is None else doc_id)
    ids = sorted(math.inf if r.doc_id is None else r.doc_id for r in kept.collect())
    assert ids == sorted(least.values())


def test_chain_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (100, 101)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def _edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""), reverse=True)
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        yield doc_id, text, text[: len(text) - cut] + after[:cut], after


def _shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("buckets", [1, 4, 60])
def test_edited_fingerprints(spark, buckets):
    rows = texts()
    got = sorted((tuple(r) for r in sketches.fingerprint_edits(documents(spark, rows), buckets=buckets).collect()), key=str)
    want = sorted(((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in _edited(rows)), key=str)
    assert [r[:3] for r in got] == want
    exact = defaultdict(list)
    for i, t, e, after in _edited(rows):
        for other in (e, after):
            a, b = _shingles(t), _shingles(other)
            exact[i].append(len(a & b) / len(a | b) if a | b else 1.0)
    for r in got:
        if r[0] is not None and len(exact[r[0]]) == 2:
            assert abs(r[5] - exact[r[0]][0]) < 0.2 and abs(r[6] - exact[r[0]][1]) < 0.2
    assert len({r[3] for r in got if r[0] in (3, 60)}) == 1


def test_a_lone_document_follows_itself(spark):
    got = sketches.fingerprint_edits(documents(spark, [(1, "abcdef")])).first()
    assert got.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 400), max_size=300), st.sets(st.integers(0, 400), max_size=300))
def test_sketches_merge_and_estimate(left, right):
    spread = lambda s: sketches.mix(np.array(sorted(s), np.uint64) + np.uint64(9))
    k = 128
    a, b = sketches.sketch(spread(left), k), sketches.sketch(spread(right), k)
    assert (sketches.merge_sketches(a, b, k) == sketches.sketch(spread(left | right), k)).all()
    assert (sketches.from_text(sketches.to_text(a)) == a).all()
    if len(left | right) < k:
        assert sketches.resemblance(a, b, k) == (len(left & right) / len(left | right) if left | right else 1.0)
        assert sketches.containment(a, b, k) == pytest.approx(len(left & right) / len(left) if left else 1.0)
        assert sketches.distinct(a, k) == len(left)


BENCHMARK = [(1, prose(1, 60)), (2, prose(12, 34)), (2, prose(12, 34)), (3, "the"), (4, None), (5, " ! "), (10, prose(999, 12)), (None, prose(13, 41))]


def _leaks(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        words = fm_index.words(text)
        for i in range(max(1, len(words) - 9) if words else 0):
            windows[tuple(words[i : i + 10])].add("" if item is None else str(item))
    lengths = sorted({len(w) for w in windows})
    for doc_id, text in rows:
        words, hit, found = fm_index.words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if owners := windows.get(tuple(words[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        yield doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [200_000, 20])
def test_contamination_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setitem(fm_index.mark_leaks.__kwdefaults__ or {}, "block_windows", block)
    monkeypatch.setattr(fm_index.mark_leaks, "__defaults__", (10, block, 3000))
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    got = fm_index.contamination(documents(spark), items).drop("items").collect()
    assert sorted(map(tuple, got), key=str) == sorted(_leaks(texts(), BENCHMARK), key=str)


def test_decontamination_cuts_the_spans_only(spark):
    items = spark.createDataFrame([(1, prose(1, 60)), (9, "Twelve words that only stand in this item and in no document.")], "item_id long, text string")
    docs = documents(spark)
    cleaned = fm_index.decontaminate(docs, items)
    assert cleaned.schema == docs.schema
    got = {r.doc_id: r.text for r in cleaned.where("doc_id is not null").collect()}
    assert 42 not in got and 43 not in got  # they hold nothing else
    assert got[40] == dict(texts())[40] and got[50] is None and got[51] == ""
    assert got[30] == prose(100, 15) + " ." + "\n" + prose(200, 12)
    empty = items.where(F.lit(False))
    assert fm_index.decontaminate(docs, empty).count() == docs.count()


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    text = rng.integers(1, 4, 500)
    text[rng.integers(0, 499, 20)] = 0
    text[-1] = 0
    index = fm_index.FMIndex(text)
    patterns = np.array([[a, b, c] for a in range(1, 4) for b in range(1, 4) for c in range(1, 5)])
    which, low, high = index.search(patterns)
    got = {tuple(patterns[w]): sorted(index.locate(np.arange(a, b)).tolist()) for w, a, b in zip(which, low, high, strict=True)}
    want = defaultdict(list)
    for i in range(498):
        if 0 not in (key := tuple(text[i : i + 3].tolist())):
            want[key].append(i)
    assert got == dict(want)


def test_empty_documents(spark):
    none = documents(spark, []).where(F.lit(False))
    items = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    assert prefix_free.removal_digests(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert sketches.fingerprint_edits(none).count() == 0
    assert fm_index.contamination(none, items).count() == 0
