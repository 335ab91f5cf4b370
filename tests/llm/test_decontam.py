import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import decontam

from .fixtures import frame, near, text


def shingles(t, k=5):
    words = re.findall(r"[^\W_]+", (t or "").lower())
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


def brute(docs, items, least=0.8):
    found = {}
    for i, t in docs:
        s = shingles(t)
        for k, x in items:
            c = Counter(shingles(x))
            n = sum(c.values())
            best = 0.0
            for a in range(max(1, len(s) - n + 1)) if n and s else []:
                w = Counter(s[a : a + n])
                both = sum((w & c).values())
                best = max(best, both / (n + min(n, len(s) - a) - both))
            if best >= least:
                found[i, k] = best
    return found


def fixture(seed=1):
    rng = random.Random(seed)
    items = [(k, text(rng, rng.choice([3, 12, 30, 55]))) for k in range(20)] + [(90, ""), (91, None), (92, "Same words same words same words same words")]
    docs = []
    for i in range(60):
        t = text(rng, rng.choice([0, 4, 50, 300]))
        if i % 3 == 0:
            passage = rng.choice(items[:20])[1]
            t = f"{t} {near(rng, passage, rng.choice([0, 1, 2]))} {text(rng, 20)}"
        docs.append((i, t))
    k, long_item = max(items[:20], key=lambda x: len(x[1]))
    docs += [(100, None), (101, ""), (102, long_item.upper().replace(" ", "*** ")), (103, " ".join(items[92 - 90 + 20][1].split()[:6])), (104, "lead " * 50 + long_item + " tail" * 50)]
    return docs, items


def test_hits_equal_brute_force(spark):
    docs, items = fixture()
    bench = spark.createDataFrame([(k, x, "extra") for k, x in items], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminations(frame(spark, docs), bench).collect()}
    expected = brute(docs, items)
    assert set(got) == set(expected) and len(got) > 5
    assert all(abs(got[x] - expected[x]) < 1e-9 for x in got)
    left = {r["doc_id"] for r in decontam.decontaminate(frame(spark, docs), bench).select("doc_id").collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in expected}


def test_item_blocks_and_empty_tables(spark, monkeypatch):
    docs, items = fixture(2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(tuple(r) for r in decontam.contaminations(frame(spark, docs), bench).collect())
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 7)
    assert sorted(tuple(r) for r in decontam.contaminations(frame(spark, docs), bench).collect()) == whole
    monkeypatch.setattr(decontam, "ITEM_BLOCK", 100_000)
    monkeypatch.setattr(decontam, "ITEM_CHARS", 500)
    assert sorted(tuple(r) for r in decontam.contaminations(frame(spark, docs), bench).collect()) == whole
    assert decontam.contaminations(frame(spark, docs), bench.limit(0)).count() == 0
    assert decontam.contaminations(frame(spark, docs).limit(0), bench).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=30), st.data(), st.integers(1, 9))
def test_fingerprints_by_their_definition(values, data, step):
    size = data.draw(st.integers(1, len(values)))
    windows = [values[i : i + size] for i in range(len(values) - size + 1)]
    expected = [sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in w) > size) for w in windows]
    before, decontam.STEP_SHINGLES = decontam.STEP_SHINGLES, step
    try:
        assert decontam.window_fingerprints(np.array(values, np.uint64), size).tolist() == expected
    finally:
        decontam.STEP_SHINGLES = before


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(0, 30), st.integers(0, 25))
def test_index_finds_all_within_the_radius(prints, wanted, flips, radius):
    rng = random.Random(flips)
    wanted += [p ^ sum(1 << b for b in rng.sample(range(64), flips)) for p in prints]
    a, b = np.array(prints, np.uint64), np.array(wanted, np.uint64)
    expected = {(i, j) for i, x in enumerate(wanted) for j, y in enumerate(prints) if (x ^ y).bit_count() <= radius}
    assert set(decontam.HammingIndex(a, radius).within(b)) == expected


def test_fingerprints_of_windows():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 2**63, 40).astype(np.uint64)
    got = decontam.window_fingerprints(s, 7)
    for i in range(34):
        ones = [sum(int(x) >> b & 1 for x in s[i : i + 7]) for b in range(64)]
        assert int(got[i]) == sum(1 << b for b, n in enumerate(ones) if 2 * n > 7)


def test_short_items_are_found_as_whole_documents_only(spark):
    assert "never inside one" in decontam.__doc__
    docs = [(1, "Three short words"), (2, "Here are three short words inside a longer document"), (3, "three short words more")]
    bench = spark.createDataFrame([(7, "three short words")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontam.contaminations(frame(spark, docs), bench).collect()] == [(1, 7)]


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 900))
def test_large_indexes_and_small_steps(seed, count):
    """More block values than the ball holds (697 here) are looked up by the ball; a step of few pairs changes nothing."""
    rng = np.random.default_rng(seed)
    prints, wanted = rng.integers(0, 2**64, count, np.uint64), rng.integers(0, 2**64, 30, np.uint64)
    index = decontam.HammingIndex(prints, 12)
    scanned = list(index.within(wanted))
    expected = {(i, j) for i, x in enumerate(wanted.tolist()) for j, y in enumerate(prints.tolist()) if (x ^ y).bit_count() <= 12}
    assert set(scanned) == expected
    kept, decontam.STEP_PAIRS = decontam.STEP_PAIRS, 7
    try:
        assert list(index.within(wanted)) == scanned
    finally:
        decontam.STEP_PAIRS = kept


def test_block_index_is_selective():
    rng = np.random.default_rng(5)
    prints, wanted = rng.integers(0, 2**64, 500, np.uint64), rng.integers(0, 2**64, 500, np.uint64)
    index = decontam.HammingIndex(prints, 23)
    near = np.zeros((500, 500), bool)
    for values, (known, order, first) in zip(index._cut(wanted), index.tables):
        for row, value in zip(*index._probed(values, known)):
            near[row, order[first[value] : first[value + 1]]] = True
    assert 0.2 < near.mean() < 0.45


def test_recall_on_a_table(spark):
    """Every window of every document that shares a shingle with an item, without fingerprints."""
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text").collect()]
    sets = {k: shingles(x) for k, x in items}
    owners: dict = {}
    for k, x in sets.items():
        for g in set(x):
            owners.setdefault(g, []).append(k)
    expected = {}
    for i, t in docs:
        s = shingles(t)
        for k in {k for g in s for k in owners.get(g, ())}:
            c, n = Counter(sets[k]), len(sets[k])
            for a in {max(0, min(p - j, len(s) - n)) for p, g in enumerate(s) if g in c for j in range(n)}:
                w = Counter(s[a : a + n])
                both = sum((w & c).values())
                expected[i, k] = max(expected.get((i, k), 0), both / (n + sum(w.values()) - both))
    expected = {x for x, v in expected.items() if v >= 0.8}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).collect()}
    assert got <= expected and len(got) >= 0.99 * len(expected) and len(expected) > 20


def test_a_phrase_of_many_items_costs_little():
    """2,000 items begin with one phrase; a document that has it 400 times holds none of them but one."""
    import time

    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 2**63, 4).astype(np.uint64)
    items = [np.concatenate([phrase, rng.integers(0, 2**63, 14).astype(np.uint64)]) for _ in range(2000)]
    held = decontam.Items(items, 23)
    doc = np.concatenate([np.concatenate([phrase, rng.integers(0, 2**63, 30).astype(np.uint64)]) for _ in range(400)] + [items[7], items[9][:-1]])
    began = time.perf_counter()
    assert held.find(doc, 0.8) == {7: (1.0, 400 * 34), 9: (17 / 19, 400 * 34 + 17)}
    assert time.perf_counter() - began < 1


@pytest.mark.parametrize("seed", range(5))
def test_rare_shingles_lead_to_all_windows(seed):
    rng = np.random.default_rng(seed)
    items = [rng.integers(0, 12, n).astype(np.uint64) for n in rng.integers(1, 20, 30)]
    doc = np.concatenate([rng.integers(0, 12, 60).astype(np.uint64), *(x for x in items[:10] for x in (x, rng.integers(0, 12, 3).astype(np.uint64)))])
    for text in (doc, items[3][:-1], doc[:5]):
        expected = {}
        for i, x in enumerate(items):
            windows = [(decontam.weighted_similarity(text[a : a + len(x)], x), -a) for a in range(max(1, len(text) - len(x) + 1))]
            best = max(windows)
            if best[0] >= 0.8:
                expected[i] = (best[0], -best[1])
        assert decontam.Items(items, 64).find(text, 0.8) == expected
