"""N-gram Jaccard join: every link between documents whose shingle sets have similarity 0.8 or more.

A document's set holds the distinct 5-word shingles of its whole text, as 64-bit hashes. The join is
exact on those sets:

1. Documents with equal sets fall into one class (by the MD5 of the sorted set); only classes go on.
2. Classes that can have no partner are dropped, first by a part and then by all of their tokens.
   Under one global order (the hash), sets of similarity 0.8 share a computable number of their first
   tokens; a class too few of whose first tokens occur elsewhere has no partner. Nor has a class
   fewer than 0.8 of whose tokens occur in other classes left. Tokens travel as sorted fingerprints of
   log2(all tokens) + 8 bits, packed by bucket: an accident only keeps a class that could have gone.
   Tokens met twice in a task's pack are counted there, and one of them goes on, so a token of very many
   documents doesn't flood one task.
3. Classes left that share one of their first ``n - ceil(0.8 n) + 1`` tokens fall into one block
   (connected components over a linear number of edges). Links never cross blocks. The order is now
   by frequency, then hash, so passages of many documents don't tie blocks together; frequencies of a
   bounded number of the most frequent tokens are known, all others count as rare. Any order is exact.
4. A block is searched by T-occurrence (DivideSkip): inverted lists of its leaders, short lists
   merged by a heap, long ones probed by bisection. A class that links to a leader joins its ball;
   other balls are compared member by member, all at once, only where the triangle inequality of the
   Jaccard distance allows a link. So groups of near copies cost no pairs.

5. Blocks of more than BLOCK_TOKENS tokens, which grow as chance ties more documents by one token, are
   first split by parts: each token falls into one of m parts by its hash, and two linked sets, that
   differ in fewer tokens than either has parts of two tokens and more, have one of these in common
   whole. So only classes that share all tokens of a part stay together (``part_keys``).
6. Blocks that are still larger are thinned out before they reach one task. Their members are
   compared with a few leaders where they lie, the most central member among them; a member whose leader
   no member of another component is near to needs no further comparison, which empties groups of near
   copies. What is left of such a block is cut into chunks of half the bound, and every two chunks are
   searched together, each chunk with a few others in a round, so that a round's copies follow the input.

No cap, sample or prefix of a text is used.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, released, rows_of_numbers, shuffles_removed, slices
from .components import connected_components
from .hashing import WHITE, mix, shingle_hashes, word_hashes

#: Similarity in hundredths.
LINK = 80
#: Rows of 8 bytes that may be broadcast, and the frequent tokens that are.
BROADCAST_ROWS = 1 << 20
#: Nodes from which on a token counts as frequent.
FREQUENT = 8
#: Tokens of a block that one task searches; leaders of a larger block in a round, and rounds.
BLOCK_TOKENS, LEADERS, ROUNDS = 1 << 20, 8, 3
#: Chunks after its own that a chunk is searched with in one round.
ROUND_CHUNKS = 2
#: Bits of a set's size from which on it is split in parts of tokens; single tokens stand for the parts of smaller sets.
PART_BITS = 8
#: Numbers that a heap merges at most; more are counted in one step.
HEAP_NUMBERS = 1000
#: Tokens that a task packs at once, and that a bucket of tokens has on average at most.
PACK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 18


def least_overlap(n: int) -> int:
    """The fewest tokens that a set of n tokens shares with a partner."""
    return -(-LINK * n // 100)


def _spare(n: int) -> int:
    return n // 10 + 1


def kept_tokens(n: int) -> int:
    """How many of its first tokens a set of n tokens shows: ``_spare(n)`` more than the classic prefix less one."""
    return n - least_overlap(n) + _spare(n)


def needed_tokens(n: int) -> int:
    """How many shown tokens of a set of n tokens some partner shows too, at least."""
    return _spare(least_overlap(n))


def text_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, first = word_hashes(column, WHITE)
    return [np.unique(shingle_hashes(words[a:b], k)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _identity(tokens: np.ndarray) -> tuple[bytes | None, int]:
    if not len(tokens):
        return None, 0
    key = hashlib.md5(tokens.astype("<u8").tobytes()).digest()
    return key, int.from_bytes(key[:8], "little", signed=True)


def _high_bytes(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each token."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _from_high_bytes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sketches(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row: uid, doc_id, text_key (hash of the text), n (set size), key (null for an empty set), node, and the upper 48 bits of the first tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = text_sets(batch.column("text"), k)
                keys = [_identity(s) for s in sets]
                shown = [_high_bytes(s[: kept_tokens(len(s))]) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in keys], pa.binary()), pa.array([x for _, x in keys], pa.int64()), pa.array(shown, pa.binary())],
                    ["doc_id", "text_key", "n", "key", "node", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, n long, key binary, node long, tokens binary").withColumn("uid", F.monotonically_increasing_id())


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values in a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(values)))


def _various(nodes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each run of ``nodes`` has more than one."""
    if not len(starts):
        return np.zeros(0, bool)
    return np.maximum.reduceat(nodes, starts) != np.minimum.reduceat(nodes, starts)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, as planes of their bytes, deflated."""
    out = []
    for x in arrays:
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [struct.pack("<IB", len(x), width), x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return zlib.compress(b"".join(out), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, at, out = zlib.decompress(data), 0, []
    while at < len(raw):
        n, width = struct.unpack_from("<IB", raw, at)
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += 5 + n * width
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _cuts(total: int) -> tuple[int, int]:
    """Bits of a fingerprint that name its bucket, and bits that are cut from a token; ``total``: all tokens."""
    return (total // BUCKET_TOKENS).bit_length(), 64 - min(48, total.bit_length() + 8)


def _token_packs(classes: DataFrame, total: int, read=lambda t: np.frombuffer(t, "<u8")) -> DataFrame:
    """Rows (bucket, data): the tokens of classes (uid, tokens) as fingerprints, by bucket of their lower bits; ``total``: all tokens.

    Of several classes of a pack that have a token, only the first one's entry goes on, with their
    number. How many tokens of a class others of the pack have too goes on in rows of its own.
    """
    low, drop = _cuts(total)

    def packs(uids: list[int], lists: list[np.ndarray]) -> pa.RecordBatch:
        token, uid = np.concatenate(lists) >> np.uint64(drop), np.repeat(np.array(uids, np.int64), [len(x) for x in lists])
        bucket, token = (token & np.uint64((1 << low) - 1)).astype(np.int64), token >> np.uint64(low)
        order = np.lexsort((token, bucket))
        bucket, token, uid = bucket[order], token[order], uid[order]
        starts = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])]))
        sizes = np.diff(np.append(starts, len(token)))
        various = _various(uid, starts)
        named, count = np.unique(uid[np.repeat(various, sizes)], return_counts=True)
        rows = [(int(bucket[0]), _pack(_steps(named), count))] if len(named) else []
        token, uid, bucket, mark = token[starts], uid[starts], bucket[starts], np.where(various, sizes, 1)
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            named, at = np.unique(uid[a:b], return_inverse=True)
            often = np.flatnonzero(mark[a:b] > 1)
            rows.append((int(bucket[a]), _pack(_steps(token[a:b]), _steps(named), at, often, mark[a:b][often])))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, lists, held = [], [], 0
        for batch in batches:
            for uid, data in zip(batch.column("uid").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                uids.append(uid)
                lists.append(read(data))
                held += len(lists[-1])
                if held >= PACK_TOKENS:
                    yield packs(uids, lists)
                    uids, lists, held = [], [], 0
        if held:
            yield packs(uids, lists)

    return classes.select("uid", "tokens").mapInArrow(run, "bucket long, data binary")


OCCURRENCES = "kind int, id long, count long, data binary"


def _occurrences(packs: DataFrame, total: int) -> DataFrame:
    """From token packs: rows of kind 0, how many tokens of classes others have too, packed by a class's bucket ``id`` (to be summed), and of kind 1, (id, count) of each frequent fingerprint.

    A bucket's entries are merged as they come, one for each fingerprint, so a frequent one takes no room.
    """
    low, _ = _cuts(total)
    mask = np.int64((1 << (total >> 22).bit_length()) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        empty = (np.zeros(0, np.uint64), none, none, np.zeros(0, bool))
        merged, waiting, held, now = empty, [], 0, None  # entries: fingerprint, class, classes met, whether that class is still to be counted
        counted = (none, none)

        def tally(uid: np.ndarray, count: np.ndarray) -> None:
            nonlocal counted
            named, at = np.unique(np.concatenate([counted[0], uid]), return_inverse=True)
            counted = named, np.bincount(at, np.concatenate([counted[1], count]), len(named)).astype(np.int64)

        def merge() -> None:
            nonlocal merged, waiting, held
            token, uid, met, new = (np.concatenate(x) for x in zip(merged, *waiting, strict=True))
            order = np.argsort(token, kind="stable")
            token, uid, met, new = token[order], uid[order], met[order], new[order]
            starts, sizes = _runs(token)
            various = _various(uid, starts)
            once = uid[np.repeat(various, sizes) & new]
            tally(once, np.ones(len(once), np.int64))
            merged = (token[starts], uid[starts], np.add.reduceat(met, starts) if len(starts) else none, new[starts] & ~various)
            waiting, held = [], 0

        def rows(kind: int, ids: list, counts: list, data: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(ids), pa.int32()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())], ["kind", "id", "count", "data"])

        def sums() -> pa.RecordBatch:
            nonlocal counted
            (uid, count), counted = counted, (none, none)
            home = (uid ^ uid >> 33) & mask
            homes = np.unique(home).tolist()
            return rows(0, homes, [None] * len(homes), [_pack(_steps(uid[home == h]), count[home == h]) for h in homes])

        def closed() -> Iterator[pa.RecordBatch]:
            if waiting:
                merge()
            often = merged[2] >= FREQUENT
            if often.any():
                tokens = (merged[0][often] << np.uint64(low) | np.uint64(now)).view(np.int64).tolist()
                yield rows(1, tokens, merged[2][often].tolist(), [None] * len(tokens))
            if len(counted[0]) >= PACK_TOKENS:
                yield sums()

        for batch in batches:
            for bucket, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "data")), strict=True):
                if bucket != now:
                    yield from closed()
                    merged, now = empty, bucket
                token, *rest = _unpack(data)
                if len(rest) == 1:
                    tally(token.cumsum().astype(np.int64), rest[0].astype(np.int64))
                    continue
                named, at, often, marks = rest
                met = np.ones(len(token), np.int64)
                met[often.astype(np.int64)] = marks
                waiting.append((token.cumsum(dtype=np.uint64), named.cumsum().astype(np.int64)[at.astype(np.int64)], met, met == 1))
                held += len(token)
                if held >= PACK_TOKENS:
                    merge()
        yield from closed()
        yield sums()

    return packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, OCCURRENCES)


def _edge_rows(classes: DataFrame, take, frequent=None) -> DataFrame:
    """Rows (token, node, mark) of each class's first ``take(n)`` tokens.

    ``frequent``: a broadcast of ascending fingerprints, their counts and how many bits are cut from a
    token; these come last in the order.
    """

    def first_of(tokens: np.ndarray, n: int) -> np.ndarray:
        return tokens[np.argsort(_frequency(tokens, frequent), kind="stable")[: take(n)]]

    return _key_rows(classes, first_of)


def _frequency(tokens: np.ndarray, frequent) -> np.ndarray:
    """How often each token occurs, 0 where it isn't in the broadcast of frequent ones."""
    if frequent is None or not len(frequent.value[0]):
        return np.zeros(len(tokens), np.int64)
    known, counts, drop = frequent.value
    cut = tokens >> np.uint64(drop)
    at = np.minimum(np.searchsorted(known, cut), len(known) - 1)
    return np.where(known[at] == cut, counts[at], 0)


def _key_rows(classes: DataFrame, keys_of) -> DataFrame:
    """Rows (token, node, mark) of the keys, ``keys_of(tokens, n)``, of each class.

    Of several nodes of a batch that have a key, only the first
    one's row goes on; the others are joined to it by rows of mark -1, pairs (token, node) of nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column("node").to_numpy(zero_copy_only=False)
            lists = [keys_of(np.frombuffer(t, "<u8"), n) for t, n in zip(batch.column("tokens").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            token = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            node = np.repeat(nodes, [len(x) for x in lists])
            order = np.argsort(token, kind="stable")
            token, node = token[order].view(np.int64), node[order]
            starts, sizes = _runs(token)
            leader = np.repeat(node[starts], sizes)
            pairs = np.unique(np.stack([leader, node], axis=1)[leader != node], axis=0)
            out = [(token[starts], node[starts], np.ones(len(starts), np.int32)), (pairs[:, 0], pairs[:, 1], np.full(len(pairs), -1, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "node", "mark"])

    return classes.select("node", "n", "tokens").mapInArrow(run, "token long, node long, mark int")


def _by_token(rows: DataFrame) -> DataFrame:
    return rows.repartition("token").sortWithinPartitions("token")


def _shared_counts(occurrences: DataFrame) -> DataFrame:
    """(uid, shared): how many tokens of each class others have too, at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        now, sums = None, (none, none)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in sums], ["uid", "shared"])

        for batch in batches:
            for home, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if home != now:
                    yield out()
                    now, sums = home, (none, none)
                uid, count = _unpack(data)
                named, at = np.unique(np.concatenate([sums[0], uid.cumsum().astype(np.int64)]), return_inverse=True)
                sums = named, np.bincount(at, np.concatenate([sums[1], count.astype(np.int64)]), len(named)).astype(np.int64)
        yield out()

    return occurrences.where("kind = 0").select("id", "data").repartition("id").sortWithinPartitions("id").mapInArrow(run, "uid long, shared long")


def _frequent_tokens(occurrences: DataFrame, total: int):
    """A broadcast of the most frequent fingerprints, BROADCAST_ROWS at most, their counts, and how many bits are cut from a token."""
    tokens = occurrences.where("kind = 1")
    levels = {r["level"]: r["count"] for r in tokens.groupBy(F.floor(F.log2("count")).alias("level")).count().collect()}
    known, least = 0, 64
    for level in sorted(levels, reverse=True):
        known += levels[level]
        if known > BROADCAST_ROWS:
            break
        least = level
    got = tokens.where(F.floor(F.log2("count")) >= least).select("id", "count").toPandas()
    prints = got["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(prints)
    return occurrences.sparkSession.sparkContext.broadcast((prints[order], got["count"].to_numpy(np.int64)[order], _cuts(total)[1]))


def _token_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b): for each token, from its first node to every other one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            token, node, mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "mark"))
            direct = mark < 0
            own = np.stack([token[direct], node[direct]], axis=1)
            token, node = (np.concatenate([h, x[~direct]]) for h, x in zip(held, (token, node), strict=True))
            starts, sizes = _runs(token)
            pairs = np.stack([np.repeat(node[starts], sizes), node], axis=1)
            pairs = np.unique(np.concatenate([own, pairs[pairs[:, 0] != pairs[:, 1]]]), axis=0)
            if len(token):
                held = (token[starts[-1] : starts[-1] + 1], node[starts[-1] : starts[-1] + 1])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return _by_token(rows).mapInArrow(run, "a long, b long").distinct()


def _heap_merge(merged: list[tuple[list[int], int]], need: int) -> dict[int, int]:
    """Numbers whose ascending lists weigh ``need`` or more together, with that weight; the heap skips numbers that can't reach it."""
    found: dict[int, int] = {}
    heap = [(x[0], i, 0) for i, (x, _) in enumerate(merged)]
    heapq.heapify(heap)
    while heap:
        value, held, popped = heap[0][0], 0, []
        while heap and heap[0][0] == value:
            popped.append(heapq.heappop(heap))
            held += merged[popped[-1][1]][1]
        if held >= need:
            found[value] = held
            target = value + 1
        else:
            while heap and held + merged[heap[0][1]][1] < need:  # these lists alone can't reach the threshold
                popped.append(heapq.heappop(heap))
                held += merged[popped[-1][1]][1]
            if not heap:
                break
            target = heap[0][0]
        for _, i, at in popped:
            x = merged[i][0]
            at = bisect_left(x, target, at)
            if at < len(x):
                heapq.heappush(heap, (x[at], i, at))
    return found


def divide_skip(lists: list[tuple[list[int], int]], least: int, mu: float = 0.0085) -> dict[int, int]:
    """Numbers whose ascending lists weigh ``least`` or more together, with that weight; ``lists``: (list, weight).

    The lists that are longest for their weight are set aside; the others are merged by a heap that skips
    numbers which can't reach the rest of the threshold (lists of more than HEAP_NUMBERS numbers by
    counting them all, which is quicker); what reaches it is looked up in the long lists by bisection.
    """
    if sum(w for _, w in lists) < least:
        return {}
    lists = sorted(lists, key=lambda x: len(x[0]) / x[1], reverse=True)
    bound = min(least - 1, int(least / (mu * max(len(x) for x, _ in lists).bit_length() + 1)))
    aside, apart, merged = 0, [], []
    for x, w in lists:
        if aside + w <= bound:
            aside += w
            apart.append((x, w))
        else:
            merged.append((x, w))
    need = least - aside
    if sum(len(x) for x, _ in merged) > HEAP_NUMBERS:
        values, at = np.unique(np.fromiter(chain.from_iterable(x for x, _ in merged), np.int64), return_inverse=True)
        held = np.bincount(at, np.repeat([w for _, w in merged], [len(x) for x, _ in merged])).astype(np.int64)
        values, held = values[held >= need], held[held >= need]
    else:
        found = _heap_merge(merged, need)
        values, held = np.array(list(found), np.int64), np.array(list(found.values()), np.int64)
    for x, w in sorted(apart, key=lambda x: x[1], reverse=True):
        if not len(values):
            break
        long = np.array(x)
        held = held + w * (long[np.minimum(np.searchsorted(long, values), len(long) - 1)] == values)
        aside -= w
        alive = held + aside >= least
        if not alive.all():
            values, held = values[alive], held[alive]
    return dict(zip(values[held >= least].tolist(), held[held >= least].tolist(), strict=True))


class Block:
    """Links among the sets of one block, as a forest over their positions.

    Tokens that the same leaders have share one inverted list, whose weight in a query is how many of
    them the query has. So a group of near copies has few lists. Tokens are numbered within the block.
    """

    #: Two steps of distance 0.2 from a leader.
    NEAR = 0.6

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.parent: list[int] = []
        self.searched = 0

    def add(self, tokens: np.ndarray) -> None:
        self.parent.append(len(self.sets))
        self.sets.append(tokens)

    def root(self, i: int) -> int:
        if self.searched < len(self.sets):
            self._search()
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def _join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def _search(self) -> None:
        """Number the tokens, forget what was found before, and search each set among the ones before it.

        Central sets come first, so that their balls are large. Sets with too few tokens in common with
        the others, even for the smallest partner that the block has for them, are left out.
        """
        self.sizes = np.array([len(s) for s in self.sets])
        universe, ids = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.ids = np.split(ids.astype(np.int32), self.sizes.cumsum()[:-1])
        self.parent, self.searched = list(range(len(self.sets))), len(self.sets)
        self.leaders: list[int] = []
        self.balls: list[list[int]] = []  # by leader: its members, and their distances
        self.reach: list[list[float]] = []
        self.group = np.full(len(universe), -1, np.int64)  # by token: its list
        self.lists: list[list[int]] = []
        self.held: list[int] = []  # tokens of each list
        self.mark = np.zeros(len(universe), bool)
        met = np.bincount(ids)
        starts = self.sizes.cumsum() - self.sizes
        shared, central = np.add.reduceat(met[ids] > 1, starts, dtype=np.int64), np.add.reduceat(met[ids], starts) / self.sizes
        ascending = np.sort(self.sizes)
        smallest = ascending[np.searchsorted(ascending, -(-LINK * self.sizes // 100))]
        alive = (100 + LINK) * shared >= LINK * (self.sizes + smallest)
        for me in np.argsort(-central, kind="stable").tolist():
            if alive[me]:
                self._place(me)

    def _place(self, me: int) -> None:
        own, n = self.ids[me], int(self.sizes[me])
        groups, weights = np.unique(self.group[own], return_counts=True)
        weight = {g: w for g, w in zip(groups.tolist(), weights.tolist(), strict=True) if g >= 0}
        near = []
        for at, both in divide_skip([(self.lists[g], w) for g, w in weight.items()], max(1, int(np.ceil(self.NEAR * n - 1e-9)))).items():
            union = n + int(self.sizes[self.leaders[at]]) - both
            if both >= self.NEAR * union - 1e-9:
                near.append((1 - both / union, at, 100 * both >= LINK * union))
        near.sort()
        for _, at, linked in near:
            if linked:
                self._join(me, self.leaders[at])
        for far, at, _ in near:
            if self.root(self.leaders[at]) != self.root(me):
                self._meet(me, np.array(self.balls[at], np.int64)[far - np.array(self.reach[at]) <= 0.2 + 1e-9])
        if near and near[0][2]:
            self.balls[near[0][1]].append(me)
            self.reach[near[0][1]].append(near[0][0])
        else:
            self._enter(own, weight)
            self.leaders.append(me)
            self.balls.append([])
            self.reach.append([])

    def _meet(self, me: int, others: np.ndarray) -> None:
        """Join ``me`` to the first of ``others`` that it links to: all of these are of one component."""
        n = int(self.sizes[me])
        sizes = self.sizes[others]
        others = others[(100 * np.minimum(sizes, n) >= LINK * np.maximum(sizes, n))]
        if not len(others):
            return
        self.mark[self.ids[me]] = True
        for at in range(0, len(others), 128):
            some = others[at : at + 128]
            sizes = self.sizes[some]
            both = np.add.reduceat(self.mark[np.concatenate([self.ids[i] for i in some.tolist()])], np.cumsum(sizes) - sizes, dtype=np.int64)
            linked = some[100 * both >= LINK * (n + sizes - both)]
            if len(linked):
                self._join(me, int(linked[0]))
                break
        self.mark[self.ids[me]] = False

    def _enter(self, own: np.ndarray, weight: dict[int, int]) -> None:
        """Put a new leader's tokens in the lists: a list whose tokens it has but in part is split."""
        me, moved, known = len(self.leaders), [], self.group[own]
        for g, w in weight.items():
            if w == self.held[g]:
                self.lists[g].append(me)
            else:
                moved.append((g, len(self.lists)))
                self.lists.append([*self.lists[g], me])
                self.held.append(w)
                self.held[g] -= w
        new = int((known < 0).sum())
        if new:
            moved.append((-1, len(self.lists)))
            self.lists.append([me])
            self.held.append(new)
        if moved:
            was, now = (np.array(x) for x in zip(*sorted(moved), strict=True))
            at = np.minimum(np.searchsorted(was, known), len(was) - 1)
            self.group[own] = np.where(was[at] == known, now[at], known)


def _search_blocks(members: DataFrame) -> DataFrame:
    """(node, root) of the linked nodes of each block; ``members``: block, node, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, nodes = None, Block(), []

        def out() -> pa.RecordBatch:
            roots = [nodes[block.root(i)] for i in range(len(nodes))]
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])

        for batch in batches:
            for at, node, tokens in zip(*(batch.column(c).to_pylist() for c in ("block", "node", "tokens")), strict=True):
                if at != now:
                    if nodes:
                        yield out()
                    now, block, nodes = at, Block(), []
                nodes.append(node)
                block.add(np.frombuffer(tokens, "<u8"))
        if nodes:
            yield out()

    ordered = members.select("block", "node", "tokens").repartition("block").sortWithinPartitions("block", "node")
    return ordered.mapInArrow(run, "node long, root long")


def _central_members(members: DataFrame) -> DataFrame:
    """(block, head): of each block, the member nearest to the tokens that half of its members have; copies of one text are near to it.

    An eighth of all tokens (one by their lower bits) is looked at, as leaders may be any members. Tokens
    are counted by batch before the shuffle; a block has at most twice a member's tokens of that kind.
    """

    def some(data: bytes) -> np.ndarray:
        tokens = np.frombuffer(data, "<u8")
        return tokens[tokens & np.uint64(7) == 0].view(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy(zero_copy_only=False)
            lists = [some(t) for t in batch.column("tokens").to_pylist()]
            rows = np.stack([np.repeat(blocks, [len(x) for x in lists]), np.concatenate(lists)]) if lists else np.zeros((2, 0), np.int64)
            order = np.lexsort(rows[::-1])
            rows = rows[:, order]
            starts = np.flatnonzero(np.concatenate([[True], (rows[:, 1:] != rows[:, :-1]).any(axis=0)])) if rows.shape[1] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0, starts]), pa.array(rows[1, starts]), pa.array(np.diff(np.append(starts, rows.shape[1])))], ["block", "token", "met"])

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for tokens, center in zip(batch.column("tokens").to_pylist(), batch.column("center").to_pylist(), strict=True):
                own, mid = some(tokens), np.array(center, np.int64)
                both = len(np.intersect1d(own, mid, assume_unique=True))
                near.append(both / max(1, len(own) + len(mid) - both))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("node"), batch.column("tokens"), pa.array(near, pa.float64())], ["block", "node", "tokens", "near"])

    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    counts = members.select("block", "tokens").mapInArrow(count, "block long, token long, met long").groupBy("block", "token").agg(F.sum("met").alias("met"))
    centers = checkpointed(counts.join(sizes, "block").where(2 * F.col("met") >= F.col("size")).groupBy("block").agg(F.collect_list("token").alias("center")))
    tokens = centers.agg(F.coalesce(F.sum(F.size("center")), F.lit(0))).first()[0]
    placed = members.join(broadcast_if_small(centers, tokens, BROADCAST_ROWS), "block").select("block", "node", "tokens", "center").mapInArrow(nearness, "block long, node long, tokens binary, near double")
    return placed.groupBy("block").agg(F.max_by(F.struct("node", "tokens"), F.struct("near", "node")).alias("head"))


def _leaders(members: DataFrame, number: int) -> DataFrame:
    """(block, heads): for each block up to LEADERS members by hash, and the most central one."""
    order = F.xxhash64("node", F.lit(number))
    slots = members.groupBy("block", F.pmod(F.shiftright(order, 8), F.lit(LEADERS)).alias("slot")).agg(F.min_by(F.struct("node", "tokens"), order).alias("head"))
    return checkpointed(slots.select("block", "head").union(_central_members(members)).groupBy("block").agg(F.array_sort(F.collect_set("head")).alias("heads")))  # LEADERS + 1 at most


NEAR_ROWS = "block long, node long, near array<struct<at: int, distance: double, linked: boolean>>"


def _near_leaders(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(block, node, near): the leaders of its block, by number, that a member is within distance 0.4 of.

    Leaders go to all workers if they have few tokens, else to their block's members by a join.
    """
    spark = members.sparkSession
    tokens = leaders.agg(F.coalesce(F.sum(F.expr("aggregate(heads, 0L, (a, h) -> a + octet_length(h.tokens) div 8)")), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast({r["block"]: [(h["node"], bytes(h["tokens"])) for h in r["heads"]] for r in leaders.toLocalIterator()}) if tokens <= BROADCAST_ROWS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = NEAR_ARROW
        for batch in batches:
            rows = []
            heads_of = [sent.value[b] for b in batch.column("block").to_pylist()] if sent else ([(h["node"], h["tokens"]) for h in x] for x in batch.column("heads").to_pylist())
            for node, data, heads in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), heads_of, strict=True):
                own, near = np.frombuffer(data, "<u8"), []
                for at, (head, its) in enumerate(heads):
                    other = np.frombuffer(its, "<u8")
                    if min(len(own), len(other)) < Block.NEAR * max(len(own), len(other)) - 1e-9:
                        continue
                    both = len(own) if node == head else len(np.intersect1d(own, other, assume_unique=True))
                    union = len(own) + len(other) - both
                    if both >= Block.NEAR * union - 1e-9:
                        near.append({"at": at, "distance": 1 - both / union, "linked": 100 * both >= LINK * union})
                rows.append(near)
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("node"), pa.array(rows, types)], ["block", "node", "near"])

    given = members.select("block", "node", "tokens") if sent else members.join(leaders, "block").select("block", "node", "tokens", "heads")
    return given.mapInArrow(run, NEAR_ROWS)


NEAR_ARROW = pa.list_(pa.struct([("at", pa.int32()), ("distance", pa.float64()), ("linked", pa.bool_())]))


def _joined(masks: list[int]) -> list[int]:
    """Sets of leaders, as bits, of which those with a leader in common are made one."""
    out: list[int] = []
    for m in masks:
        apart = [x for x in out if not x & m]
        for x in out:
            m |= x if x & m else 0
        out = [*apart, m]
    return out


def _leader_round(members: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """New edges, and the members that links to other components may still involve.

    A member y of a ball around leader l and a member x linked to it are at most ``distance(y, l) + 0.2``
    from l. So y needs no search if no node of another component is as near to l as that. Components are
    those of the links to leaders; a block has few leaders, so few sets of them that a member links to.
    """
    leaders = _leaders(members, number)
    near = checkpointed(_near_leaders(members, leaders))
    linked = F.filter("near", lambda x: x["linked"])
    mask = F.aggregate(linked, F.lit(0), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), x["at"])))
    placed = near.withColumn("mask", mask)

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array([_joined(m) for m in batch.column("masks").to_pylist()], pa.list_(pa.int32()))], ["block", "sets"])

    sets = checkpointed(placed.where("mask <> 0").groupBy("block").agg(F.collect_set("mask").alias("masks")).mapInArrow(components, "block long, sets array<int>"))
    count = sets.count()
    # A member's component is the set of leaders that it belongs to; one that links to none is its own.
    of = placed.join(broadcast_if_small(sets, count, BROADCAST_ROWS), "block").withColumn("set", F.coalesce(F.get(F.filter("sets", lambda x: x.bitwiseAND(F.col("mask")) != 0), F.lit(0)), F.lit(0)))
    at = of.select("block", "node", "set", F.inline("near")).withColumn("foreign", F.col("set").bitwiseAND(F.expr("shiftleft(1, at)")) == 0)
    nearest = checkpointed(at.groupBy("block", "at").agg(F.min(F.when(F.col("foreign"), F.col("distance"))).alias("foreign_distance")))
    done = at.where("linked").join(broadcast_if_small(nearest, count * (LEADERS + 1), BROADCAST_ROWS), ["block", "at"]).where(F.col("foreign_distance").isNull() | (F.col("foreign_distance") > F.col("distance") + 0.2 + 1e-9)).select("node").distinct()
    done = checkpointed(done)
    heads = leaders.select("block", F.posexplode("heads.node").alias("at", "leader"))
    edges = at.where("linked").select("block", "node", "at").join(broadcast_if_small(heads, count * (LEADERS + 1), BROADCAST_ROWS), ["block", "at"]).where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    return checkpointed(edges), checkpointed(members.join(broadcast_if_small(done, done.count(), BROADCAST_ROWS), "node", "left_anti"))


def part_level(n: int) -> int:
    """By what parts a set of n tokens is compared with those of its size and smaller ones: the bits of n."""
    return n.bit_length()


def _levels(n: int) -> list[int]:
    """The levels at which a set of n tokens may meet a partner: that of the larger of both."""
    return list(range(part_level(n), part_level(100 * n // LINK) + 1))


def most_differing(n: int, other: int) -> int:
    """In how many tokens two linked sets of n and ``other`` tokens differ at most."""
    return (n + other) * (100 - LINK) // (100 + LINK)


def parts(tokens: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each part of a set at a level: its key, its number of tokens and where its tokens begin. Equal parts have equal keys.

    A set of that level has 1.4 to 2.8 tokens for each part, and more parts than it can differ from a linked smaller set in.
    Below PART_BITS each token is a part.
    """
    salt = mix(np.array([level], np.uint64))
    if level < PART_BITS:
        return mix(tokens ^ salt), np.ones(len(tokens), np.int64), np.arange(len(tokens))
    m = -(-10 * (1 << level - 1) // 14)
    at = (tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)  # ascending, as tokens are
    ends = np.searchsorted(at, np.arange(m + 1, dtype=np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens), dtype=np.uint64)])
    return mix((sums[ends[1:]] - sums[ends[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) + salt)), np.diff(ends), ends[:-1]


def _strong(level: int) -> int:
    """The tokens that a part has at least to count: a single one is too often had by chance."""
    return 2 if level >= PART_BITS else 1


def scant_keys(tokens: np.ndarray, n: int) -> np.ndarray:
    """Keys that also count wherever they are met, for a set with so few strong parts that a link may touch them all: those of all its parts, if need be of empty ones."""
    level = part_level(n)
    key, size, _ = parts(tokens, level)
    differing = most_differing(n, n)
    if not n or (size >= _strong(level)).sum() > differing:
        return np.zeros(0, np.uint64)
    return key[size > 0] if (size > 0).sum() > differing else key


def part_keys(tokens: np.ndarray, n: int, frequent=None, scant: np.ndarray | None = None) -> np.ndarray:
    """Keys of which linked sets have one in common, at the level of the larger one.

    At each level these are the strong parts with the rarest tokens, one more than a link may touch: of
    two linked sets' strong parts all but so many are equal, and the first ones of both under one order
    meet. ``scant``: the ascending keys of ``scant_keys`` of all sets; null: all keys count.
    """
    out = []
    for level in _levels(n):
        key, size, start = parts(tokens, level)
        if scant is None:
            out.append(key)
            continue
        strong = size >= _strong(level)
        often = np.minimum.reduceat(_frequency(tokens, frequent), start[size > 0])[strong[size > 0]] if len(tokens) else np.zeros(0, np.int64)
        mine = key[strong]
        out.append(mine[np.lexsort((mine, often))[: most_differing(n, 100 * n // LINK) + 1]])
        if len(scant):
            out.append(key[scant[np.minimum(np.searchsorted(scant, key), len(scant) - 1)] == key])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _split_by_parts(members: DataFrame, frequent=None) -> DataFrame:
    """``members`` (block, node, n, tokens) with smaller blocks: those of classes tied by a part of their tokens. Who is tied to nobody is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [scant_keys(np.frombuffer(t, "<u8"), n) for t, n in zip(batch.column("tokens").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.uint64), *lists])).view(np.int64))], ["key"])

    few = checkpointed(members.select("n", "tokens").mapInArrow(run, "key long").distinct())
    scant = np.sort(few.toPandas()["key"].to_numpy(np.int64).view(np.uint64)) if few.count() <= BROADCAST_ROWS else None
    sent = members.sparkSession.sparkContext.broadcast(scant)
    edges = _token_edges(_key_rows(members, lambda tokens, n: part_keys(tokens, n, frequent, sent.value)))
    tied = checkpointed(connected_components(edges))
    # Edges between blocks are chance, so a block and a component name the new block.
    return checkpointed(members.join(broadcast_if_small(tied, tied.count(), BROADCAST_ROWS), "node").select(F.xxhash64("block", "component").alias("block"), "node", "n", "tokens"))


def _chunk_pairs(rest: DataFrame) -> Iterator[DataFrame]:
    """Members (block, node, tokens) of blocks to search: every two chunks of each block of ``rest``, by rounds that hold each member a few times."""
    chunks = checkpointed(rest.groupBy("block").agg(F.ceil(2 * F.sum("n") / BLOCK_TOKENS).cast("int").alias("chunks")))
    whole = F.col("chunks") <= 2
    cut = rest.join(broadcast_if_small(chunks, chunks.count(), BROADCAST_ROWS), "block").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    yield cut.where(whole).select("block", "node", "tokens")
    steps = (chunks.agg(F.coalesce(F.max("chunks"), F.lit(0))).first()[0]) // 2
    for first in range(1, steps + 1, ROUND_CHUNKS):
        near = [F.pmod(F.col("own") + F.lit(sign * d), F.col("chunks")) for d in range(first, min(first + ROUND_CHUNKS, steps + 1)) for sign in (1, -1)]
        reach = [F.lit(d) <= F.col("chunks") / 2 for d in range(first, min(first + ROUND_CHUNKS, steps + 1)) for _ in (1, -1)]
        others = F.array_compact(F.array_distinct(F.array(*[F.when(r, x) for r, x in zip(reach, near, strict=True)])))
        yield cut.where(~whole).withColumn("other", F.explode(others)).select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node", "tokens")


def _larger(members: DataFrame) -> tuple[DataFrame, int]:
    """(block) of the blocks of more than BLOCK_TOKENS tokens, and their number."""
    sizes = checkpointed(members.groupBy("block").agg(F.sum("n").alias("size")).where(F.col("size") > BLOCK_TOKENS).select("block"))
    return sizes, sizes.count()


def _block_links(members: DataFrame, frequent=None) -> DataFrame:
    """(node, root) of the linked nodes of all blocks; ``members``: block, node, n, tokens."""
    sizes, large = _larger(members)
    if not large:
        return _search_blocks(members).groupBy("node").agg(F.min("root").alias("root"))
    side = broadcast_if_small(sizes, large, BROADCAST_ROWS)
    split = _split_by_parts(members.join(side, "block", "left_semi"), frequent)
    members = members.join(side, "block", "left_anti").select("block", "node", "n", "tokens").unionByName(split)
    sizes, large = _larger(split)
    if not large:
        return _search_blocks(members).groupBy("node").agg(F.min("root").alias("root"))
    side = broadcast_if_small(sizes, large, BROADCAST_ROWS)
    rest = checkpointed(split.join(side, "block", "left_semi").select("block", "node", "n", "tokens"))
    edges = members.sparkSession.createDataFrame([], "a long, b long")
    count = rest.count()
    for number in range(ROUNDS):
        found, left = _leader_round(rest, number)
        edges = edges.union(found)
        released(rest)
        rest, before = left, count
        count = rest.count()
        if 10 * count > 9 * before or rest.groupBy("block").agg(F.sum("n").alias("size")).where(F.col("size") > BLOCK_TOKENS).isEmpty():
            break  # little is gained, or little is left
    for number, some in enumerate(_chunk_pairs(rest)):
        if not number:  # blocks that one task searches whole
            some = members.join(side, "block", "left_anti").select("block", "node", "tokens").unionByName(some)
        found = _search_blocks(some).where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        edges = edges.union(checkpointed(found.distinct()))
    return connected_components(edges).select("node", F.col("component").alias("root"))


#: Ids are looked up by so many bits of their hash before they are joined.
ID_BITS = 26


@shuffles_removed
def near_classes(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, text_key (xxhash64 of the text), n, and class, which linked rows share; null without shingles."""
    read = checkpointed(sketches(docs, k))
    # Equal sets show equally many tokens. Only the classes' tokens go on, and they are shuffled packed.
    first = checkpointed(read.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull(), "uid")).getField("uid").alias("uid"), F.max(F.octet_length("tokens")).alias("size")).select("uid", "size"))
    total = first.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // 6
    shown = rows_of_numbers(read.select("uid", "tokens"), first.select("uid"), F.col("uid"))
    shared = _shared_counts(_occurrences(_token_packs(shown, total, _from_high_bytes), total))
    likely = checkpointed(read.select("uid", "node", "doc_id", "n").join(shared, "uid").where(F.col("shared") >= F.floor(F.ceil(F.col("n") * LINK / 100) / 10) + 1).select("uid", "node", "doc_id", "n"))
    all_docs = checkpointed(read.select("doc_id", "text_key", "n", "node", "key"))
    released(read)  # nothing from here on reads the tokens shown
    count, total = likely.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = text_sets(batch.column("text"), k)
                yield pa.RecordBatch.from_arrays([pa.array([_identity(s)[1] for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "n", "tokens"])

    # A class is fetched by the id of one of its rows, by a null one only where it has no other.
    wanted = likely.select(F.col("doc_id").alias("_wanted")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if count > BROADCAST_ROWS:  # only the texts of these ids, and a few more, are shuffled
        bit = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << ID_BITS))
        texts = rows_of_numbers(texts, wanted.select(F.pmod(F.xxhash64(F.coalesce("_wanted", F.lit(0))), F.lit(1 << ID_BITS))), bit)
    texts = texts.join(broadcast_if_small(wanted, count, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    sets = checkpointed(texts.select("text").mapInArrow(whole_sets, "node long, n long, tokens binary").join(broadcast_if_small(likely.select("node", "uid"), count, BROADCAST_ROWS), "node"))
    occurrences = checkpointed(_occurrences(_token_packs(sets, total), total))
    covered = checkpointed(likely.join(_shared_counts(occurrences), "uid").where(F.col("shared") >= F.ceil(F.col("n") * LINK / 100)).select("node"))
    left = sets.join(broadcast_if_small(covered, count, BROADCAST_ROWS), "node", "left_semi")
    frequent = _frequent_tokens(occurrences, total)
    edges = _token_edges(_edge_rows(left, lambda n: n - least_overlap(n) + 1, frequent))
    blocks = checkpointed(connected_components(edges).select("node", F.col("component").alias("block")))
    members = sets.join(broadcast_if_small(blocks, count, BROADCAST_ROWS), "node").select("block", "node", "n", "tokens")
    roots = checkpointed(_block_links(members, frequent))
    released(sets)

    return all_docs.select("doc_id", "text_key", "n", "node", "key").join(broadcast_if_small(roots, count, BROADCAST_ROWS), "node", "left").select("doc_id", "text_key", "n", F.when(F.col("key").isNotNull(), F.coalesce("root", "node")).alias("class"))


def near_components(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    A document without words or text has no shingles and is linked with nothing; its component is its
    own id. Rows with equal ids are documents of their own. Null ids are never a component's id, unless
    a component has no other. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    labelled = near_classes(docs, k)
    # Checkpointed, so the join that follows is one that adaptive execution can split where a class is hot.
    least = checkpointed(labelled.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id")))
    return labelled.join(least, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for the rows of ``near_components`` where ids are unique and not null: all pairs by shared shingles, then their closure."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= {LINK} * (u.n + v.n - c)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""
