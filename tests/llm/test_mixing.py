"""Mixing against a plain sampler; its plan runs without Python."""

import hashlib
import math
import random
import re

import pytest

from starledger.llm import mixing

from .fixtures import text


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Shares by weight; whatever is above its bound stops there and the rest is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    held, total = {}, sum(sizes.values())
    while True:
        left = {s: w for s, w in weight.items() if s not in held}
        share = {s: w * (total - sum(held.values())) / sum(left.values()) for s, w in left.items()}
        over = {s: epochs * sizes[s] for s in share if share[s] >= epochs * sizes[s]}
        if not over:
            return held | share
        held |= over
        if len(held) == len(weight):
            return held


def plain(rows, quality):
    """rows: (doc_id, source, text)."""
    docs = [(k, s, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for k, s, t in rows]
    sizes = {}
    for _, s, n in docs:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = plain_targets(sizes), []
    for s in sizes:
        key = lambda k: -math.log((int(hashlib.sha256(f"7:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / quality.get(k, 1.0)
        whole = math.floor(goal[s] / sizes[s]) if sizes[s] else 0
        rest = math.floor(goal[s]) - whole * sizes[s]
        for k, n in sorted(((k, n) for k, src, n in docs if src == s), key=lambda x: key(x[0])):
            part = max(0, min(n, rest))
            rest -= part
            out.append((k, n, sizes[s], round(goal[s], 6), whole * n + part))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(k, s, t, 2.5, "x") for k, s, t in rows], "doc_id long, source string, text string, weight double, key string").repartition(3)


@pytest.mark.parametrize("seed", range(4))
def test_mix_equals_plain_sampler(spark, seed):
    rng = random.Random(seed)
    names = ["b", "a", "é", "z", "Z", "", None, "tiny", "blank"][: 4 + seed * 2]
    rows = [(i, rng.choice(names + names[:1] * 6), text(rng, rng.choice([0, 1, 5, 30, 200]))) for i in range(150)]
    rows += [(900, "tiny", "one two"), (901, "blank", None), (902, "blank", " \t\n"), (903, "b", "x" * 5000), (904, "a", text(rng, 50_000)), (905, "b", "x" * 300_000)]
    quality = {i: rng.choice([0.5, 2.0]) for i, _, _ in rows[::3]}
    weights = spark.createDataFrame(list(quality.items()), "doc_id long, weight double")
    got = mixing.mix(frame(spark, rows), weights)
    assert sorted((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()) == plain(rows, quality)
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Arrow" not in plan


@pytest.mark.parametrize("seed", range(6))
def test_targets_share_all_sizes(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 1, 7, 10 ** rng.randrange(1, 9)]) for i in range(rng.randrange(1, 60))}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in got} == want
    assert sum(r.target for r in got) == pytest.approx(sum(sizes.values()))


def test_running_sums_over_ranges(spark):
    rows = [(i, (i * 7919) % 10_000) for i in range(10_000)]
    got = mixing.running(spark.createDataFrame(rows, "k long, v long"), [mixing.F.col("k")], {"upto": "v"}).orderBy("k").collect()
    total = 0
    for (k, v), r in zip(rows, got):
        total += v
        assert r.upto == total


def test_sampling_prefers_good_documents(spark):
    rows = [(i, "s", "w " * 10) for i in range(2000)] + [(5000 + i, "t", "w") for i in range(40)]
    quality = spark.createDataFrame([(i, 4.0) for i in range(0, 2000, 2)], "doc_id long, weight double")
    taken = {r.doc_id: r.taken for r in mixing.mix(frame(spark, rows), quality, weights=(1, 2)).collect()}
    assert max(taken.values()) <= 30 and all(taken[i] <= 3 for i in range(5000, 5040))
    half = mixing.mix(frame(spark, [r for r in rows if r[1] == "s"] + [(9000 + i, "t", "w " * 10) for i in range(2000)]), quality, weights=(1, 3)).where("doc_id < 2000").collect()
    assert sum(r.taken for r in half if r.doc_id % 2 == 0) > 1.5 * sum(r.taken for r in half if r.doc_id % 2)


def test_missing_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "s", "a b c")] * 4 + [(1, "s", "x y")] * 3 + [(None, None, None)]
    first, again = (sorted(map(tuple, mixing.mix(frame(spark, rows)).collect()), key=str) for _ in range(2))
    assert first == again and len(first) == 8
    assert sum(r[4] for r in first) == sum(r[1] for r in first)
    assert mixing.mix(frame(spark, rows).where("false")).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(map(tuple, mixing.quality_weights(labels).collect())) == [(1, 2.0), (2, 0.5)]
