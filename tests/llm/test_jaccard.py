import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starledger.llm import common, jaccard
from starledger.llm.components import connected_components
from starledger.llm.hashing import shingle_hashes, word_hashes

from .fixtures import documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least.setdefault(root(a), []).append(i)
    return sorted((i, len(s), i if not s else min((x for x in least[root(a)] if x is not None), default=None)) for a, (i, s) in enumerate(sets))


def result(df):
    return sorted(tuple(r) for r in jaccard.near_components(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = documents(seed)
    assert result(frame(spark, rows)) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (5, "other text here"), (3, "A B C D E F G"), (9, "p q r s t u v w x y z"), (9, "p q r s t u v w x y z")]
    assert result(frame(spark, rows)) == brute(rows)


def test_empty_table_and_null_ids(spark):
    assert result(frame(spark, [(1, "x")]).limit(0)) == []
    got = jaccard.near_components(frame(spark, [(None, "a b c d e"), (4, "a b c d e"), (None, "lonely words"), (None, None)])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(None, 1, 4), (4, 1, 4), (None, 1, None), (None, 0, None)], key=str)


def test_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(150)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    assert result(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("bound,rounds", [(20_000, 1), (4000, 3)])
def test_large_blocks_are_split(spark, monkeypatch, bound, rounds):
    """Groups of near copies, chains and mixtures, with so low a bound that blocks go through leader rounds and chunks."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", bound)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 1 << 20 if rounds > 1 else 0)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    rng = random.Random(7)
    rows, base = [], [f"w{i}" for i in range(120)]
    for i in range(250):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            words[rng.randrange(120)] = f"v{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    chain = list(base)
    for i in range(40):
        chain[rng.randrange(120)] = f"z{i}"
        rows.append((1000 + i, " ".join(chain)))
    rows += [(2000 + i, t) for i, t in documents(6)]
    assert result(frame(spark, rows)) == brute(rows)


def test_blocks_tied_by_chance_are_not_copied(spark, monkeypatch):
    """Pairs of near copies, tied to other pairs by short passages: one block, of which every two chunks were searched together."""
    rng, rows = random.Random(3), []
    word = lambda: f"w{rng.randrange(10**9)}"
    passages = [[word() for _ in range(24)] for _ in range(150)]
    for i in range(150):
        words = [*passages[i], *(word() for _ in range(170)), *passages[i * 7 % 150], *passages[(i + 1) % 150]]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words, word()]))]
    searched, search = [], jaccard._search_blocks
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(jaccard, "_search_blocks", lambda members: searched.append(members.count()) or search(members))
    assert result(frame(spark, rows)) == brute(rows)
    assert sum(searched) <= 2 * len(rows)


@pytest.mark.parametrize("chunks", [3, 4, 7])
def test_rounds_bring_every_two_chunks_together(spark, monkeypatch, chunks):
    rows = [(1, i, 1, b"") for i in range(50 * chunks)] + [(2, -1, 1, b""), (2, -2, 1, b"")]
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 100)
    met, own = set(), {r[0]: r[1] for r in spark.createDataFrame([(r[1],) for r in rows], "node long").selectExpr("node", f"pmod(xxhash64(node), {chunks})").collect()}
    for members in jaccard._chunk_pairs(spark.createDataFrame(rows, "block long, node long, n long, tokens binary")):
        blocks, copies = {}, Counter()
        for r in members.collect():
            blocks.setdefault(r["block"], set()).add(r["node"])
            copies[r["node"]] += 1
        assert max(copies.values(), default=0) <= 2 * jaccard.ROUND_CHUNKS
        met |= {(a, b) for nodes in blocks.values() for a in nodes for b in nodes}
    assert all((a, b) in met for a in own for b in own if (a < 0) == (b < 0))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 600), st.integers(0, 2**32), st.sampled_from([1, 4, 8]))
def test_linked_sets_have_a_part_in_common(n, seed, bits):
    rng, was = np.random.default_rng(seed), jaccard.PART_BITS
    one = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    gone, more = rng.integers(0, n // 5 + 1), rng.integers(0, n // 4 + 1)
    other = np.unique(np.concatenate([rng.permutation(one)[gone:], rng.integers(0, 1 << 64, more, dtype=np.uint64)]))
    both = len(np.intersect1d(one, other))
    if 100 * both < 80 * (len(one) + len(other) - both):
        return
    known = np.unique(rng.permutation(np.concatenate([one, other]))[: n // 3])
    frequent = type("Sent", (), {"value": (known, rng.integers(8, 20, len(known)), 0)})
    try:
        jaccard.PART_BITS = bits  # below 8, sets without enough parts of two tokens are met
        scant = np.unique(np.concatenate([jaccard.scant_keys(x, len(x)) for x in (one, other)]))
        for a, b in ((frequent, scant), (None, None)):
            assert len(np.intersect1d(jaccard.part_keys(one, len(one), a, b), jaccard.part_keys(other, len(other), a, b)))
    finally:
        jaccard.PART_BITS = was


@pytest.mark.parametrize("most", [1 << 11, 0])
def test_rows_are_looked_up_by_bits(spark, monkeypatch, most):
    """Numbers at the edges of bytes and runs, and of several partitions; joined where there are too many runs."""
    monkeypatch.setattr(common, "BROADCAST_BITS", most)
    edges = [0, 1, 7, 8, 32767, 32768, 65535, 65536, (1 << 33) + 5, (5 << 33) + 40000]
    rows = spark.createDataFrame([(n, "x") for n in [*range(100, 140), *edges, 7]], "uid long, _of string")
    chosen = [*range(100, 140, 3), *edges[::2], 99]
    found = common.rows_of_numbers(rows, spark.createDataFrame([(n,) for n in chosen], "uid long"), rows["uid"])
    assert found.columns == ["uid", "_of"]
    assert sorted(r[0] for r in found.collect()) == sorted([*set(chosen) - {99}, 7])


def test_many_classes_shuffle_no_whole_tokens(spark, monkeypatch):
    """Where classes are too many to be sent by id, they are sent as bits; jobs leave no shuffle files."""
    key, plans, packs = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], jaccard._token_packs
    before = spark.conf.get(key)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "_token_packs", lambda classes, *rest: plans.append((classes._jdf.queryExecution().executedPlan().toString(), spark.conf.get(key))) or packs(classes, *rest))
    rows = documents(4)
    assert result(frame(spark, rows)) == brute(rows)
    plan, cleaned = plans[0]
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    assert cleaned == "true" and spark.conf.get(key) == before


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 30), unique=True, min_size=1).map(sorted), st.integers(1, 5)), min_size=1, max_size=12), st.integers(1, 30))
def test_divide_skip_counts(lists, least):
    total = Counter()
    for x, w in lists:
        total.update(dict.fromkeys(x, w))
    expected = {v: n for v, n in total.items() if n >= least}
    assert jaccard.divide_skip(lists, least) == expected
    kept, jaccard.HEAP_NUMBERS = jaccard.HEAP_NUMBERS, 0
    try:
        assert jaccard.divide_skip(lists, least) == expected
    finally:
        jaccard.HEAP_NUMBERS = kept


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 12), min_size=1, max_size=12), min_size=1, max_size=14))
def test_block_finds_all_links(sets):
    block = jaccard.Block()
    for s in sets:
        block.add(np.array(sorted(s), np.uint64))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert [block.root(i) for i in range(len(sets))] == [root(i) for i in range(len(sets))]


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.data())
def test_shown_tokens_meet_the_bound(n, data):
    """Two sets of similarity 0.8 share at least the needed number of shown tokens."""
    x = sorted(data.draw(st.sets(st.integers(0, 10**6), min_size=n, max_size=n)))
    drop = data.draw(st.integers(0, n // 5))
    y = sorted(set(x[: n - drop]) | set(data.draw(st.lists(st.integers(0, 10**6), max_size=n // 5))))
    if 100 * len(set(x) & set(y)) >= 80 * len(set(x) | set(y)):
        shown = set(x[: jaccard.kept_tokens(len(x))]) & set(y[: jaccard.kept_tokens(len(y))])
        assert len(shown) >= jaccard.needed_tokens(len(x))
        p = [z[: len(z) - jaccard.least_overlap(len(z)) + 1] for z in (x, y)]
        assert set(p[0]) & set(p[1])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbBéÉ \t\n\x0b\x1c.", max_size=40)), max_size=8), st.integers(0, 3))
def test_hashes_follow_words(texts, start):
    column = pa.array([None] * start + texts, pa.string())[start:]
    words, first = word_hashes(column)
    names: dict = {}
    for i, t in enumerate(texts):
        expected = WORD.findall((t or "").translate(LOWER))
        assert first[i + 1] - first[i] == len(expected)
        for w, h in zip(expected, words[first[i] : first[i + 1]].tolist()):
            assert names.setdefault(w, h) == h
        assert len(set(shingle_hashes(words[first[i] : first[i + 1]]).tolist())) == len(shingles(t))
    assert len(set(names.values())) == len(names)


def test_long_words_hash_alike():
    words, first = word_hashes(pa.array(["x" * 300 + " " + "x" * 301, "X" * 300, "y" * 256 + " " + "y" * 257]))
    assert words[0] == words[2] != words[1] and len(set(words.tolist())) == 4


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(50)] + [(100, x) for x in range(101, 160)] + [(200, 200), (None, 3), (7, 8)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    import itertools

    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if None not in (a, b) and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: root(x) for x in itertools.chain(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sql_states_the_same(spark):
    import duckdb

    rows = documents(8, 6)
    con = duckdb.connect()
    con.sql("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(jaccard.oracle()).fetchall()) == brute(rows)


def test_null_ids_with_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    whole, lone, far = " ".join(words), " ".join(f"u{i}" for i in range(60)), " ".join([*(f"u{i}" for i in range(59)), "other"])
    rows = [(None, whole), (5, whole), (6, near), (None, lone), (7, far)]
    for order in (rows, rows[::-1]):
        got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_components(frame(spark, order)).collect()), key=str)
        assert got == sorted([(None, 5), (5, 5), (6, 5), (None, 7), (7, 7)], key=str)


def test_packs_keep_their_numbers():
    arrays = [np.array(x, np.uint64) for x in ([], [0, 0, 7], [2**63, 1, 2**64 - 1], [255, 256])]
    assert [a.tolist() for a in jaccard._unpack(jaccard._pack(*arrays))] == [a.tolist() for a in arrays]


@pytest.mark.parametrize("pack,bucket", [(1 << 20, 1 << 18), (40, 16)])
def test_occurrences_count_shared_tokens(spark, monkeypatch, pack, bucket):
    """Also with packs and buckets so small that a bucket is merged many times, and with a class on two rows."""
    monkeypatch.setattr(jaccard, "PACK_TOKENS", pack)
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", bucket)
    rng = random.Random(4)
    universe = [rng.getrandbits(64) for _ in range(60)]
    sets = {uid: sorted(rng.sample(universe, rng.randrange(1, 20)) + [rng.getrandbits(64) for _ in range(5)]) for uid in range(30)}
    rows = [(uid, bytearray(np.array(s, "<u8").tobytes())) for uid, s in sets.items()]
    total = sum(map(len, sets.values()))
    read = jaccard._occurrences(jaccard._token_packs(spark.createDataFrame(rows + rows[:1], "uid long, tokens binary").repartition(3), total), total)
    met = Counter(t for s in sets.values() for t in s)
    got = {r["uid"]: r["shared"] for r in jaccard._shared_counts(read).collect()}
    for uid, s in sets.items():
        least = sum(met[t] > 1 for t in s)
        assert got.get(uid, 0) == least or uid == 0 and got.get(uid, 0) >= least
    drop = jaccard._cuts(total)[1]
    often = {t >> drop: n for t, n in met.items() if n >= jaccard.FREQUENT}
    found = {r["id"] % 2**64: r["count"] for r in read.where("kind = 1").collect()}
    assert set(often) <= set(found) and all(0 <= found[t] - n <= 1 for t, n in often.items())
    empty = spark.createDataFrame([], "uid long, tokens binary")
    assert jaccard._occurrences(jaccard._token_packs(empty, 0), 0).count() == 0
