"""Importance resampling against a plain count of every feature, whatever the chunks."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from starledger.llm import crc, importance

from .fixtures import documents, frame, near, text

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")


def features(value, n=2):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in value or "")
    words = WORD.findall(lowered)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, percent=25, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x)[1]) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for key, value in rows:
        words, found = features(value)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in map(bucket, found))
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0]))[: percent * sum(r[4] for r in out) // 100]
    rank = {r[0]: i + 1 for i, r in enumerate(drawn)}
    return sorted((*r[:4], rank.get(r[0])) for r in out)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_sums_of_runs(n):
    rng = random.Random(n)
    rows = ["", None, "a", "A b", "é " * 5, "x" * 300 + " y", "q" * 70 + " " + "z" * 20_000 + " 1", "a-b\nc", *["".join(rng.choice("abé 09.\n界🎈Z") for _ in range(rng.randrange(80))) for _ in range(200)]]
    sums, firsts, words = crc.gram_sums(pa.array(rows), n)
    for i, value in enumerate(rows):
        found, grams = features(value, n)
        assert words[i] == len(found)
        assert [int(x) for s, f in zip(sums, firsts) for x in s[f[i] : f[i + 1]]] == [zlib.crc32(g.encode()) for g in grams]


def test_adjoining_rows_keep_their_words():
    assert crc.gram_sums(pa.array(["ab", "cd"]), 2)[2].tolist() == [1, 1]


@pytest.mark.parametrize("size", [1, 7, 64, 1000])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_chunks_own_each_run_once(size, n):
    rng = random.Random(size)
    for _ in range(40):
        value = "".join(rng.choice("abé .\n界") for _ in range(rng.randrange(300)))
        parts = list(importance.cut(value.encode(), n, size))
        assert sum(own for own, _ in parts) == len(value.encode())
        sums, _, _ = crc.gram_sums(pa.array([c.decode() for _, c in parts], pa.string()), n, pa.array([o for o, _ in parts], pa.int64()).to_numpy())
        assert Counter(int(x) for s in sums for x in s) == Counter(zlib.crc32(f.encode()) for f in features(value, n)[1])


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return documents(5, 10) + [(1000 + i, text(rng, rng.choice([19, 20, 21, 400]))) for i in range(40)]


@pytest.mark.parametrize("size", [100, importance.CHUNK_BYTES])
def test_resample_equals_plain_count(spark, rows, size):
    rng = random.Random(9)
    target = [near(rng, rows[5][1] or text(rng, 30), 2), text(rng, 50), None, ""]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance.resample(frame(spark, rows).repartition(3), bench, size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, target)


def test_very_long_text_in_chunks(spark):
    rng = random.Random(2)
    rows = [(1, text(rng, 60_000)), (2, text(rng, 30)), (3, "ü" * 200_000)]
    bench = spark.createDataFrame([(1, text(rng, 40))], "item_id long, text string")
    assert sorted(tuple(r) for r in importance.resample(frame(spark, rows), bench).collect()) == plain(rows, [bench.first().text])


def test_empty_tables_and_missing_ids(spark):
    docs, bench = frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert importance.resample(docs.where("false"), bench).count() == 0
    assert importance.resample(docs, bench.where("false")).first().rank is None
    rng = random.Random(1)
    same = text(rng, 25)
    got = importance.resample(frame(spark, [(None, same)] * 3 + [(4, same)] * 5), bench, percent=100).collect()
    assert len(got) == 8 and sorted(r["rank"] for r in got) == list(range(1, 9))
    assert len({r["score"] for r in got if r["doc_id"] is None}) == 1
